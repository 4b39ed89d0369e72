"""One consistent form of text that looks the same but is coded differently.

``canonical`` gives NFC of the compatibility form, with invisible characters dropped, look-alike letters and quotes
unified, and every run of white space one blank. Only unstable segments (found by the normalization quick-check
properties) are normalised, each with its preceding starter as boundary context; the rest of a text is left as it is.

Letters of Latin, Greek and Cyrillic that look alike are unified by the word: a word that has a letter found in Cyrillic
(or Greek) alone is written in that script, any other in Latin letters. What a word becomes depends only on how it looks.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa

#: Forms that Unicode doesn't decompose though they look alike. Yiddish digraphs are two letters in one
#: code point; geresh and gershayim look like the quote marks of the same words; the Hebrew letterlike signs decompose.
ALIKE = {
    "װ": "וו",  # double vav
    "ױ": "וי",  # vav yod
    "ײ": "יי",  # double yod
    "׳": "'",  # geresh
    "״": '"',  # gershayim
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "‐": "-",  # hyphen
}
#: Cyrillic and Greek letters that look like Latin ones, out of Unicode's public table of confusable characters.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹονϲϳ", "ABEZHIKMNOPTYXCovcj", strict=True))
_LATIN = str.maketrans(CYRILLIC | GREEK)
#: The way back takes the first of several letters.
_BACK = {script: str.maketrans({latin: ch for ch, latin in reversed(table.items())}) for script, table in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK))}
#: Combining grapheme joiner, which is invisible but no format character.
JOINERS = frozenset("͏")


def _script(ch: str) -> str:
    """CYRILLIC or GREEK; empty for all else."""
    return next((s for s in _BACK if unicodedata.name(ch, "").startswith(s)), "")


#: Blocks of both scripts, and words with a letter of them.
_EITHER = "[\u0370-\u052f\u1c80-\u1c8f\u1d26-\u1d2b\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]"
_TWO_SCRIPTS = re.compile(rf"(?:[^\W\d_]|[\u0300-\u036f])*{_EITHER}(?:[^\W\d_]|[\u0300-\u036f])*")


def _one_script(match: re.Match[str]) -> str:
    word = unicodedata.normalize("NFD", match.group(0)).translate(_LATIN)
    scripts = {_script(c) for c in word} - {""}
    return unicodedata.normalize("NFC", word.translate(_BACK[scripts.pop()]) if len(scripts) == 1 else word)


def one_script(text: str) -> str:
    """``text`` with the words of Cyrillic and Greek letters in one script each."""
    return _TWO_SCRIPTS.sub(_one_script, text)


def _gone(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in JOINERS


def _whole(text: str) -> str:
    """The canonical form of a whole text, without shortcuts and without joining of blanks."""
    text = "".join(c for c in text if not _gone(c))
    text = "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", text))
    text = "".join(" " if c.isspace() else c for c in text if not _gone(c))
    return unicodedata.normalize("NFC", text)


def canonical_plain(text: str | None) -> str | None:
    """The same form computed over the whole text; what :class:`Canonical` is tested against."""
    return None if text is None else " ".join(x for x in one_script(_whole(text)).split(" ") if x)


class Canonical:
    """Canonical forms, with the quick-check classes of the characters met so far."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.unstable: set[str] = set()
        self.marks: set[str] = set()
        self.segment: re.Pattern[str] | None = None
        self.scripts = False

    def _learn(self, chars: set[str]) -> None:
        new = chars - self.seen
        if not new:
            return
        self.seen |= new
        self.scripts = self.scripts or any(_script(d) for c in new for d in unicodedata.normalize("NFKD", c))
        for c in new:
            if unicodedata.combining(c):
                self.marks.add(c)
            # A letter that takes part in composition only beside others (quick check: maybe) is no mark but unstable.
            if not unicodedata.is_normalized("NFKC", c) or c in ALIKE or _gone(c) or (c.isspace() and c != " ") or 0x1160 <= ord(c) <= 0x11FF or 0xA960 <= ord(c) <= 0xD7FF and not 0xAC00 <= ord(c) <= 0xD7A3:
                self.unstable.add(c)
        bad, marks = "".join(map(re.escape, self.unstable)), "".join(map(re.escape, self.marks))
        # Marks that compose with their starter, or stand in an order that may change, need their starter too.
        parts = []
        if marks:
            parts.append(f"[^{marks}]?[{marks}]+")
        if bad:
            both = f"[{bad}{marks}]"
            parts.insert(0, f"(?:[^{marks}{bad}][{marks}]*)?[{bad}]{both}*" if marks else f"[^{bad}]?[{bad}]+")
        self.segment = re.compile("|".join(parts)) if parts else None
        self.cache: dict[str, str] = {}

    def _splice(self, match: re.Match[str]) -> str:
        raw = match.group(0)
        out = self.cache.get(raw)
        if out is None:
            out = _whole(raw)
            if len(self.cache) < 65536:
                self.cache[raw] = out
        return out

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        self._learn(set(text))
        if self.segment is not None and not (text.isascii() and not self.unstable):
            text = self.segment.sub(self._splice, text)
        if self.scripts:
            text = one_script(text)
        return " ".join(x for x in text.split(" ") if x)


def canonical_column(column: str, out: str):
    """A function for ``mapInArrow`` that adds ``out``, the canonical form of ``column``, as the last column."""

    def run(batches):
        form = Canonical()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([form(v) for v in values], pa.string())], names=[*batch.schema.names, out])

    return run


class Plain(dict):
    """A translation table to comparison form: letters and digits in lower case, white space as blanks, nothing else.

    Lower-case letters that look like Latin ones become these, whatever the word.
    """

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        parts = "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", ch))
        out = "".join(c.lower().translate(_LATIN) if c.isalnum() else " " if c.isspace() else "" for c in parts)
        # Lower case may bring marks back.
        out = "".join(c for c in unicodedata.normalize("NFKD", out) if c.isalnum() or c == " ")
        self[code] = out
        return out
