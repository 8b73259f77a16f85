"""What a subtitle text says: its spoken words, without cue layout, tags, labels, sounds and adverts, in one form."""

from __future__ import annotations

import re
import unicodedata

# Layout of cues, and what is no speech.
LAYOUT = re.compile(r"^[^\S\n]*﻿?(?:\d+[^\S\n]*$|\d+:\d\d:\d\d[.,]\d[^\n]*$|WEBVTT[^\n]*$)", re.M)
TAGS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
#: A sound note ends at its closing mark, at the latest with its cue, which an empty line ends.
_NOTE = r"(?:[^{0}{1}\n]|\n(?![^\S\n]*\n))*"
SOUNDS = re.compile(rf"\({_NOTE.format('(', ')')}\)|\[{_NOTE.format('\\[', '\\]')}\]|♪{_NOTE.format('♪', '')}♪|♪|#[^#\n]+#")
#: Addresses: of mail, of the web, and telephone numbers.
MAIL = r"[\w.+-]+@[\w-]+\.\w[\w.-]*"
WEB = r"(?:https?://|www\.)\S+|\b[\w-]+\.(?:example|invalid|com|net|org|info|tv)\b\S*"
ADDRESS = re.compile(rf"{MAIL}|{WEB}|\b\d{{3}}-\d{{3,4}}\b", re.I)
#: What any address holds; cheap to search for.
TRIGGER = re.compile(r"@\w|\.(?:example|invalid|com|net|org|info|tv)\b|www\.|https?:|\d{3}-\d{3}", re.I)
#: What else marks a line with an address as an advert: an invitation, folded, or that little else stands in it.
INVITES = frozenset("anuncia anuncie anunciate advertise descarga descargue download baixe visita visite visit get more mas mais llama llame call ligue siguenos follow suscribete subscribe".split())
LITTLE = 2
CREDIT = re.compile(
    r"^[^\w\n]*(?:traducid[oa] por|traduzido por|translated by|subt[^\n ]{1,4}tulos (?:de|por)|subtitles by|captions by|legendas\s*:|legendas de|sincroni[^\n ]{1,3}\s*:|sync and|sync(?:ed)? by|correcci[^\n ]{1,5}n\s*:|corrections by|revis[^\n ]{1,5}o\s*:|revisi[^\n ]{1,5}n\s*:)",
    re.M | re.I,
)
LABELS = re.compile(r"^([^\S\n]*(?:[-–—][^\S\n]*)?)[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ0-9.'’ ]+:(?=\s)", re.M)
BROKEN = re.compile("[ÂÃâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}")
#: Letters of Latin-1 read as the old code page 850, and characters that such a reading alone gives.
OLD_PAGE = {ord(bytes([b]).decode("cp850")): bytes([b]).decode("latin-1") for b in range(0xBF, 0x100)}
OLD_CHARS = frozenset("┐└┴╔╚╩¾Ýßþ·Ò±")
OLD_SIGNS = re.compile("(?<=[a-zA-Z])[¾Ýßþ·Ò±](?=[a-z])|[┐└┴╔╚╩]")
#: Signs misread for letters, where letters follow or stand around.
SIGNS = re.compile(r"[!@|](?=[^\W\d_])|(?<=[^\W\d_])[@|]")
SIGN_LETTERS = {"!": "i", "@": "a", "|": "l"}
LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|�")
#: Everything but letters and digits parts words.
PARTS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Stands for a letter that a wrong encoding lost.
LOST_LETTER = "9"


def _mend(match: re.Match[str]) -> str:
    raw = b"".join(c.encode("cp1252") if c.encode("cp1252", "ignore") else c.encode("latin-1", "ignore") for c in match.group())
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return match.group()


def mend_encoding(text: str) -> str:
    """UTF-8 read as Latin-1 or Windows-1252, once or twice, and Latin-1 read as code page 850, are set right."""
    if text.isascii():
        return text
    for _ in range(3):
        if not ("Ã" in text or "Â" in text or "â" in text):
            break
        text = BROKEN.sub(_mend, text)
    if not OLD_CHARS.isdisjoint(text) and OLD_SIGNS.search(text):
        text = text.translate(OLD_PAGE)
    return text


def _advert(line: str) -> bool:
    """Whether a line with an address holds nothing but an advert: it invites as well, or little else stands in it."""
    rest = fold(ADDRESS.sub(" ", line)).translate(PARTS).decode().split()
    return len(rest) <= LITTLE or not INVITES.isdisjoint(rest)


def without_adverts(text: str) -> str:
    """A text without lines that are adverts or credits; from other lines only an address goes."""
    out, at = [], 0
    for start, credit in sorted((m.start(), r is CREDIT) for r in (TRIGGER, CREDIT) for m in r.finditer(text)):
        if start < at:
            continue
        left = text.rfind("\n", 0, start) + 1 if text[start] != "\n" else start + 1
        right = text.find("\n", left)
        right = len(text) if right < 0 else right
        line = text[left:right]
        if credit or ADDRESS.search(line):
            out.append(text[at : max(at, left)])
            if not credit and not _advert(line):
                out.append(ADDRESS.sub(" ", line))
            at = right
    return "".join([*out, text[at:]]) if at else text


def spoken(text: str | None) -> str:
    """The speech of a subtitle text, with its line breaks and punctuation. Null gives ''."""
    if not text:
        return ""
    text = mend_encoding(text.replace("\r\n", "\n").replace("\r", "\n"))
    text = without_adverts(TAGS.sub("", LAYOUT.sub("", text)))
    return LABELS.sub(r"\1", SOUNDS.sub(" ", text))


def fold(text: str) -> bytes:
    """Small letters without accents or characters that show nothing; a lost letter is marked, and signs misread for letters are read as such."""
    text = text.lower()
    if "?" in text or "�" in text:
        text = LOST.sub(LOST_LETTER, text)
    if "!" in text or "@" in text or "|" in text:
        text = SIGNS.sub(lambda m: SIGN_LETTERS[m.group()], text)
    return (text if text.isascii() else unicodedata.normalize("NFKD", text)).encode("ascii", "ignore")


def words(text: str | None) -> list[bytes]:
    """Folded spoken words of a subtitle text."""
    return fold(spoken(text)).translate(PARTS).split()


def plain_words(text: str | None) -> list[bytes]:
    """Folded words of a text that is no subtitle."""
    return fold(mend_encoding(text or "")).translate(PARTS).split()
