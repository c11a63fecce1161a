"""Byte-level BPE vocabularies: reading one, and encoding text chunk by chunk with a memo.

The vocabulary is read from the ``tokenizers`` JSON file itself; merges are ranked by the id of their
result, which is the order of that file's merge list for vocabularies built by successive merges.
"""

from __future__ import annotations

import json

import regex

#: Fixed value: the pre-token pattern of byte-level BPE with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its memo at this many chunks; that bounds memory and changes no result.
MEMO = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes to id, and the special strings that the library matches inside texts by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pre = data["pre_tokenizer"]
        if data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in s): i for s, i in data["model"]["vocab"].items() if s not in self.special}
        self.size = max([*self.ranks.values(), *self.special.values()]) + 1

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def splitter(self):
        """Cuts a text at the special strings, longest first; None if there are none."""
        if not self.special:
            return None
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def proven(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that encode, alone, as one token: proved by encoding each."""
        enc, pattern, found = self.encoding(), regex.compile(PATTERN), []
        for raw, number in self.ranks.items():
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if pattern.fullmatch(s) and pattern.findall(s) == [s] and enc.encode_ordinary(s) == [number]:
                found.append(s)
        return frozenset(found)


#: A space before another white-space character or at the end: there a space needn't begin a pre-token.
ODD_SPACE = regex.compile(r" (?=\s|\Z)")


def chunks(text: str) -> list[str]:
    """Cut a text before each space; every pre-token lies in one chunk.

    A pre-token takes a space only at its start or within white space, so a space that a non-space follows
    always begins one.  Texts with other spaces are cut at those safe spaces only.
    """
    if ODD_SPACE.search(text):
        parts = regex.split(r" (?=\S)", text)
    else:
        parts = text.split(" ")
    return [parts[0], *(" " + p for p in parts[1:])] if parts[0] else [" " + p for p in parts[1:]]
