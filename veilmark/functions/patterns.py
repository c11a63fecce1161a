"""Detection patterns as data: (entity type, regular expression, priority).

Fixed values: the nine structured formats, with the priorities that settle overlaps (a larger one wins).
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    entity_type: str
    regex: str
    priority: int
    #: A cheap condition that any text with a match fulfils (Java regular expression).
    guard: str = "[0-9]{3}"
    #: A Java expression with the same matches that takes linear time, where ``regex`` doesn't.
    linear: str | None = None


#: A match begins where its run of characters does, or where the match before ended, and takes the run whole: so no
#: place within a run is tried again.
LINEAR_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

PATTERNS = [
    Pattern("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 9, "@", LINEAR_EMAIL),
    Pattern("RRN", r"(?<!\d)\d{6}-[1-4]\d{6}(?!\d)", 8, "[0-9]{6}-[1-4]"),
    Pattern("ACCOUNT", r"(?<![\d-])\d{3}-\d{2}-\d{6}(?![\d-])", 7, "[0-9]-[0-9]{2}-[0-9]"),
    Pattern("CARD", r"(?<![\d-])\d{4}-\d{4}-\d{4}-\d{4}(?![\d-])", 7, "[0-9]{4}-[0-9]{4}-"),
    Pattern("CARD", r"(?<!\d)\d{16}(?!\d)", 6, "[0-9]{16}"),
    Pattern("PHONE", r"(?<![\d-])01[016789]-\d{3,4}-\d{4}(?![\d-])", 6, "01[016789]-"),
    Pattern("PHONE", r"(?<!\d)01[016789]\d{7,8}(?!\d)", 5, "01[016789][0-9]{7}"),
    Pattern("PASSPORT", r"(?<![A-Za-z0-9])[MSROD]\d{8}(?![A-Za-z0-9])", 5, "[MSROD][0-9]{8}"),
    Pattern("IMEI", r"(?<!\d)\d{15}(?!\d)", 4, "[0-9]{15}"),
]

#: Entity types that patterns cover; the others need a model.
STRUCTURED = ("EMAIL", "RRN", "ACCOUNT", "CARD", "PHONE", "PASSPORT", "IMEI")
MODELLED = ("PERSON", "ADDRESS")

#: Entity type, column category, mask token, detection layer.
TYPE_MAP = [
    ("RRN", "IDENTIFICATION", "[주민번호]", "PATTERN"),
    ("PHONE", "PERSONAL_INFO", "[전화번호]", "PATTERN"),
    ("EMAIL", "PERSONAL_INFO", "[이메일]", "PATTERN"),
    ("CARD", "PAYMENT_INFO", "[카드번호]", "PATTERN"),
    ("ACCOUNT", "PAYMENT_INFO", "[계좌번호]", "PATTERN"),
    ("IMEI", "IDENTIFICATION", "[단말식별번호]", "PATTERN"),
    ("PASSPORT", "IDENTIFICATION", "[여권번호]", "PATTERN"),
    ("PERSON", "PERSONAL_INFO", "[이름]", "NER"),
    ("ADDRESS", "PERSONAL_INFO", "[주소]", "NER"),
]
MASK_TOKENS = {t: token for t, _, token, _ in TYPE_MAP}

CATEGORIES = ("PERSONAL_INFO", "PAYMENT_INFO", "IDENTIFICATION", "EMPLOYMENT_INFO", "NON_PII")

#: Names that language models give to the entity types.
TYPE_NAMES = {
    "PERSON": "PERSON", "이름": "PERSON", "NAME": "PERSON",
    "PHONE": "PHONE", "전화": "PHONE", "전화번호": "PHONE", "휴대폰": "PHONE", "MOBILE": "PHONE",
    "RRN": "RRN", "주민등록번호": "RRN", "주민번호": "RRN", "SSN": "RRN",
    "CARD": "CARD", "카드": "CARD", "카드번호": "CARD", "CREDIT_CARD": "CARD",
    "ACCOUNT": "ACCOUNT", "계좌": "ACCOUNT", "계좌번호": "ACCOUNT", "BANK": "ACCOUNT",
    "EMAIL": "EMAIL", "이메일": "EMAIL", "메일": "EMAIL",
    "ADDRESS": "ADDRESS", "주소": "ADDRESS", "LOCATION": "ADDRESS",
    "IMEI": "IMEI", "단말식별번호": "IMEI",
    "PASSPORT": "PASSPORT", "여권": "PASSPORT", "여권번호": "PASSPORT",
}

#: Value formats and the category that each speaks for; the order decides.
VALUE_RULES = [
    (r"^[0-9]{6}-[1-4][0-9]{6}$", "IDENTIFICATION"),
    (r"^01[016789]-?[0-9]{3,4}-?[0-9]{4}$", "PERSONAL_INFO"),
    (r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "PERSONAL_INFO"),
    (r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}$", "PAYMENT_INFO"),
    (r"^[0-9]{3}-[0-9]{2}-[0-9]{6}$", "PAYMENT_INFO"),
    (r"^[0-9]{15}$", "IDENTIFICATION"),
    (r"^[0-9]{13,19}$", "PAYMENT_INFO"),
    (r"^[가-힣]{2,4}$", "PERSONAL_INFO"),
    (r"(시|도).*(구|군)", "PERSONAL_INFO"),
    (r"^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$", "PERSONAL_INFO"),
]
#: Words in column names; the second list has no word for device numbers.
NAME_RULES = [
    ("card|account|acct|bank", "PAYMENT_INFO"),
    ("salary", "EMPLOYMENT_INFO"),
    ("rrn|ssn|passport|imei", "IDENTIFICATION"),
    ("name|email|phone|mobile|tel|addr|address|birth|contact|memo", "PERSONAL_INFO"),
]
NAME_WORDS = "name|email|phone|mobile|tel|rrn|ssn|passport|card|account|acct|bank|salary|addr|address|birth|contact|memo"
