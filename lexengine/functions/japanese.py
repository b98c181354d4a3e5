"""Japanese text functions: scripts, kana, morae, pitch and furigana."""

from __future__ import annotations

import re
import unicodedata

#: Kana that join the one before them into one mora.
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"
#: Half-width kana and marks in the order of their code points from U+FF66.
_HALF = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_VOICED = {"カ": "ガ", "キ": "ギ", "ク": "グ", "ケ": "ゲ", "コ": "ゴ", "サ": "ザ", "シ": "ジ", "ス": "ズ", "セ": "ゼ", "ソ": "ゾ", "タ": "ダ", "チ": "ヂ", "ツ": "ヅ", "テ": "デ", "ト": "ド", "ハ": "バ", "ヒ": "ビ", "フ": "ブ", "ヘ": "ベ", "ホ": "ボ", "ウ": "ヴ"}
_HALF_VOICED = {"ハ": "パ", "ヒ": "ピ", "フ": "プ", "ヘ": "ペ", "ホ": "ポ"}
#: Kana by vowel, for prolonged sounds.
_VOWELS = {
    "a": "ぁあかがさざただなはばぱまゃやらゎわヵァアカガサザタダナハバパマャヤラヮワヵヷ",
    "i": "ぃいきぎしじちぢにひびぴみりゐィイキギシジチヂニヒビピミリヰヸ",
    "u": "ぅうくぐすずっつづぬふぶぷむゅゆるゥウクグスズッツヅヌフブプムュユルヴ",
    "e": "ぇえけげせぜてでねへべぺめれゑヶェエケゲセゼテデネヘベペメレヱヶヹ",
    "o": "ぉおこごそぞとどのほぼぽもょよろをォオコゴソゾトドノホボポモョヨロヲヺ",
}
_VOWEL_OF = {c: v for v, cs in _VOWELS.items() for c in cs}
_PROLONGED = {"a": "あ", "i": "い", "u": "う", "e": "え", "o": "う"}
_KANJI = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF), (0x2F800, 0x2FA1F), (0x30000, 0x323AF), (0xF900, 0xFAFF))
_JAPANESE = (*_KANJI, (0x3040, 0x30FF), (0xFF66, 0xFF9F), (0x30FB, 0x30FC), (0xFF61, 0xFF65), (0x3000, 0x303F), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF01, 0xFF0F), (0xFF1A, 0xFF1F), (0xFF3B, 0xFF3F), (0xFF5B, 0xFF60), (0xFFE0, 0xFFEE))


def in_ranges(c: str, ranges) -> bool:
    return any(a <= ord(c) <= b for a, b in ranges)


def is_kanji(c: str) -> bool:
    return in_ranges(c, _KANJI)


def is_kana(c: str) -> bool:
    return "぀" <= c <= "ヿ"


def is_japanese(c: str) -> bool:
    return in_ranges(c, _JAPANESE)


def entirely_kana(text: str) -> bool:
    return bool(text) and all(map(is_kana, text))


def partially_japanese(text: str) -> bool:
    return any(map(is_japanese, text or ""))


def to_hiragana(text: str, keep_prolonged: bool = False) -> str:
    """Katakana as hiragana; a prolonged sound becomes the vowel before it unless it is kept. Small ka and ke stay."""
    out = ""
    for c in text:
        if c == "ー" and not keep_prolonged:
            vowel = _VOWEL_OF.get(out[-1]) if out else None
            out += _PROLONGED[vowel] if vowel else c
        elif "ァ" <= c <= "ヶ" and c not in "ヵヶ":
            out += chr(ord(c) - 0x60)
        else:
            out += c
    return out


def to_katakana(text: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


def to_full_width(text: str) -> str:
    """ASCII letters and digits in full width."""
    return "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in text)


def to_half_width(text: str) -> str:
    return re.sub("[０-９Ａ-Ｚａ-ｚ]", lambda m: chr(ord(m[0]) - 0xFEE0), text)


def half_kana_to_full(text: str) -> str:
    """Half-width kana in full width, together with a voicing mark behind them."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if "ｦ" <= c <= "ﾝ":
            full, mark = _HALF[ord(c) - 0xFF66], text[i + 1 : i + 2]
            if mark == "ﾞ" and full in _VOICED:
                full, i = _VOICED[full], i + 1
            elif mark == "ﾟ" and full in _HALF_VOICED:
                full, i = _HALF_VOICED[full], i + 1
            out += full
        else:
            out += c
        i += 1
    return out


def compose_marks(text: str) -> str:
    """Kana with combining voicing marks as one character."""
    return re.sub("[ぁ-ヿ][゙゚]", lambda m: unicodedata.normalize("NFC", m[0]), text)


def compatibility(text: str) -> str:
    """Squared words and units (U+3300 to U+33FF) spelt out."""
    return re.sub("[㌀-㏿]", lambda m: unicodedata.normalize("NFKD", m[0]), text)


def repeat_marks_to_kanji(text: str) -> str:
    """Iteration marks as the kanji before them."""
    out = ""
    for c in text:
        out += out[-1] if c == "々" and out and is_kanji(out[-1]) else c
    return out


def kanji_to_repeat_marks(text: str) -> str:
    """A kanji that follows itself as an iteration mark."""
    out, last = "", ""
    for c in text:
        if is_kanji(c) and c == last:
            out, last = out + "々", ""
        else:
            out, last = out + c, c
    return out


def collapse_emphatic(text: str, full: bool) -> str:
    """Runs of っ, ッ and ー inside of a word as one of them, or as none if full; those at the ends stay."""
    marks = "っッー"
    left, right = 0, len(text)
    while left < right and text[left] in marks:
        left += 1
    while right > left and text[right - 1] in marks:
        right -= 1
    middle = re.sub(r"([っッー])\1*", "" if full else r"\1", text[left:right])
    return text[:left] + middle + text[right:]


def morae(text: str) -> list[str]:
    out: list[str] = []
    for c in text:
        if c in SMALL_KANA and out:
            out[-1] += c
        else:
            out.append(c)
    return out


def is_mora_high(index: int, pitch: int | str) -> bool:
    """Whether a mora is high, by the place of the downstep or a text of H and L."""
    if isinstance(pitch, str):
        return pitch[index : index + 1] == "H"
    return {0: index > 0, 1: index < 1}.get(pitch, 0 < index < pitch)


def downsteps(pattern: str) -> list[int]:
    """Places where H is followed by L; without any, 0 if it begins low, else -1."""
    found = [i for i in range(1, len(pattern)) if pattern[i - 1] == "H" and pattern[i] == "L"]
    return found or [0 if pattern.startswith("L") else -1]


def pitch_category(reading: str, pitch: int | str, verb_or_adjective: bool = False) -> str | None:
    if isinstance(pitch, str):
        pitch = downsteps(pitch)[0]
    if pitch == 0:
        return "heiban"
    if verb_or_adjective:
        return "kifuku" if pitch > 0 else None
    if pitch == 1:
        return "atamadaka"
    if pitch > 1:
        return "odaka" if pitch >= len(morae(reading)) else "nakadaka"
    return None


def _runs(term: str) -> list[tuple[bool, str]]:
    out: list[tuple[bool, str]] = []
    for c in term:
        kana = is_kana(c)
        if out and out[-1][0] == kana:
            out[-1] = (kana, out[-1][1] + c)
        else:
            out.append((kana, c))
    return out


def _ways(runs, reading: str, plain: str) -> list[list[tuple[str, str]]]:
    """At most two ways to deal a reading out to runs of kana and others."""
    if not runs:
        return [[]] if not reading else []
    (kana, text), rest = runs[0], runs[1:]
    if kana:
        if not plain.startswith(to_hiragana(text)):
            return []
        n = len(text)
        own = [(text, "")] if reading[:n] == text else [(c, "" if c == r else r) for c, r in zip(text, reading[:n])]
        return [own + more for more in _ways(rest, reading[n:], plain[n:])]
    found: list[list[tuple[str, str]]] = []
    for n in range(len(reading), len(text) - 1, -1):
        for more in _ways(rest, reading[n:], plain[n:]):
            found.append([(text, reading[:n]), *more])
            if len(found) > 1:
                return found
    return found


def furigana(term: str, reading: str) -> list[tuple[str, str]]:
    """(text, reading) of a term's parts; where there are several ways to deal the reading out, the term as a whole."""
    if reading == term or not reading:
        return [(term, "")]
    ways = _ways(_runs(term), reading, to_hiragana(reading))
    return ways[0] if len(ways) == 1 else [(term, reading)]


def furigana_inflected(term: str, reading: str, source: str) -> list[tuple[str, str]]:
    """furigana of a term's stem that source shares, followed by the rest of source."""
    plain_term, plain_reading, plain_source = to_hiragana(term), to_hiragana(reading), to_hiragana(source)

    def common(a: str, b: str) -> int:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    by_term, by_reading = common(plain_term, plain_source), common(plain_reading, plain_source)
    if by_reading > 0 and by_reading >= by_term and plain_reading != plain_term:
        head = source[:by_reading]
        return [(head, "" if head == reading[:by_reading] else reading[:by_reading]), *([(source[by_reading:], "")] if by_reading < len(source) else [])]
    cut = len(term) - by_term
    stem = reading[: len(reading) - cut] if cut else reading
    out = furigana(term[:by_term], stem) if by_term else []
    return [*out, *([(source[by_term:], "")] if by_term < len(source) else [])]


#: Latin letters of the kana, row by row of the table of sounds, without the vowel.
_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの",
    "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ",
}
#: Kana whose letters the table does not give.
_ODD = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ゔ": "vu"}
_SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゎ": "wa"}
_LETTERS = {c: r + v for r, cs in _ROWS.items() for c, v in zip(cs, "aiueo")} | _ODD


def to_romaji(text: str) -> str:
    """Kana in Latin letters; other characters stay. A small tsu doubles the next consonant, n is set off before a vowel."""
    kana, out = to_hiragana(text, keep_prolonged=True), []
    for i, c in enumerate(kana):
        if c in _SMALL and out and i and kana[i - 1] in _LETTERS and _LETTERS[kana[i - 1]]:
            before, own = out.pop(), _SMALL[c]
            stem = before[:-1]
            out.append(stem + (own[1:] if own[0] == "y" and stem.endswith(("sh", "ch", "j")) else own))
        elif c == "っ":
            ahead = _LETTERS.get(kana[i + 1 : i + 2], "")
            out.append("t" if ahead.startswith("ch") else ahead[:1] if ahead[:1] not in ("", *"aiueo") else "")
        elif c == "ん":
            out.append("n'" if _LETTERS.get(kana[i + 1 : i + 2], "x")[0] in "aiueoy" else "n")
        elif c == "ー" and out and out[-1]:
            out.append(out[-1][-1])
        else:
            out.append(_LETTERS.get(c, _SMALL.get(c, c)))
    return "".join(out)


def from_romaji(text: str) -> str:
    """Latin letters as hiragana, the longest spelling first; what is none stays."""
    spelled: dict[str, str] = {}
    for c, letters in _LETTERS.items():
        spelled.setdefault(letters, c)
        if len(letters) > 1 and letters.endswith("i"):  # with a small y-sound behind it
            stem = letters[:-1]
            for small in "ゃゅょ":
                spelled.setdefault(stem + (_SMALL[small][1:] if stem in ("sh", "ch", "j") else _SMALL[small]), c + small)
    for row, cs in _ROWS.items():  # spellings by the table, such as si and tu
        for c, v in zip(cs, "aiueo"):
            spelled.setdefault(row + v, c)
    out, i, low = [], 0, text.lower()
    while i < len(low):
        for size in (4, 3, 2, 1):
            if kana := spelled.get(low[i : i + size]):
                out.append(kana)
                i += size
                break
        else:
            c, ahead = low[i], low[i + 1 : i + 2]
            if c == "n" and ahead != "y":
                out.append("ん")
                i += 1 + (ahead == "'") + (ahead == "n" and low[i + 2 : i + 3] not in tuple("aiueoy"))
            elif c == ahead and c.isascii() and c.isalpha() or (c == "t" and low[i + 1 : i + 3] == "ch"):
                out.append("っ")
                i += 1
            else:
                out.append("ー" if c == "-" else text[i])
                i += 1
    return "".join(out)


def kana_script(c: str) -> str | None:
    """hiragana or katakana, if a character is either."""
    return "hiragana" if 0x3041 <= ord(c) <= 0x309F else "katakana" if 0x30A0 <= ord(c) <= 0x30FF or 0xFF66 <= ord(c) <= 0xFF9F else None


def kana_diacritic(c: str) -> tuple[str, str] | None:
    """The kana below a diacritic, and its name."""
    parts = unicodedata.normalize("NFD", c)
    name = {"\u3099": "dakuten", "\u309a": "handakuten"}.get(parts[1:])
    return (parts[0], name) if name else None


def is_korean(c: str) -> bool:
    """Whether a character is a Korean syllable or letter."""
    return in_ranges(c, ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)))
