"""The words of a text in typesetting markup, for comparison with plain text."""

from __future__ import annotations

import re
import unicodedata

_MACRO = re.compile(r"\\(?:(?:new|renew|provide)command\*?\s*\{?\\([A-Za-z]+)\}?|def\s*\\([A-Za-z]+))\s*\{([^{}\\$]{1,200})(?:\\xspace)?\}")
#: Commands whose argument is no text of the passage, footnotes of at most two words, and the names of all other commands.
_MARKUP = re.compile(
    r"\\(?:[a-zA-Z]*cite[a-zA-Z]*|ref|eqref|autoref|cref|pageref|label|index|gls|hspace|vspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}"
    r"|\\(?:footnote|footnotetext|thanks|marginpar)\{\s*[^{}\s]*\s*[^{}\s]*\s*\}|\\[a-zA-Z]+\*?(?:\{\})?|\\\\"
)
#: What may stand inside a word: a hyphen at a line's end (the next line may be commented out), a discretionary one,
#: hyphens, apostrophes and what broken encodings made of them.
_INSIDE = re.compile(r"(?<=\w)(?:\\-|-[ \t]*\r?\n[ \t]*%*[ \t]*|â€™|['’‘ʼ`´\ufffd\u00ad\u2010\u2011-])(?=\w)")
_ACCENT = re.compile(r"\\[\"'^`~=.]")
_WORD = re.compile(r"[a-z0-9]+")


def expanded(text: str) -> str:
    """Macros that stand for plain words, replaced by them."""
    if "command" not in text and "\\def" not in text:
        return text
    macros = {a or b: body for a, b, body in _MACRO.findall(text)}
    macros = {k: v for k, v in macros.items() if any(c.isalpha() for c in v)}
    if not macros:
        return text
    return re.sub(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?", lambda m: f" {macros[m[1]]} ", text)


def words(text: str | None) -> list[str]:
    """Lower-case runs of ASCII letters and digits; markup is left out, hyphens and apostrophes inside words too."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\\" in text:
        text = _MARKUP.sub(" ", _ACCENT.sub("", expanded(text)))
    return _WORD.findall(_INSIDE.sub("", text).lower())
