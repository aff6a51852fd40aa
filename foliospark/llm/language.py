"""The language of a piece of text."""

from __future__ import annotations

import unicodedata

# Frequent function words by which a language is known.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for with as are by this from were which",
    "de": "der die und das ist nicht mit den von dem ein eine wurde werden auf sich auch",
    "fr": "le la les des et est une dans que pour qui par sur sont avec nous",
    "es": "el los las que y del una por con para se como fue son es al",
    "it": "il di che della non sono per una con dei nel alla gli stato questo",
    "pt": "os das uma para com por foi como mais em ao pela pelo dos",
    "nl": "het een van niet zijn met voor op aan werd worden dat door bij",
}
_LANGUAGES: dict[str, list[str]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGES.setdefault(_word, []).append(_name)


def language(text: str) -> str:
    """The language of a text by its function words, else the script of its last letters, else "none"."""
    votes: dict[str, int] = {}
    for word in text.lower().split():
        for name in _LANGUAGES.get(word, ()):
            votes[name] = votes.get(name, 0) + 1
    if votes and (most := max(votes.values())) > 1:
        return min(n for n, v in votes.items() if v == most)
    scripts: dict[str, int] = {}
    for c in text[-40:]:
        if c.isalpha():
            name = "latin" if c < "ɐ" else unicodedata.name(c, "other").split()[0].lower()
            scripts[name] = scripts.get(name, 0) + 1
    return min(scripts, key=lambda n: (-scripts[n], n)) if scripts else "none"
