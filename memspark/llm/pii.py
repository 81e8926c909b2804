"""Personal data in free text, found and replaced by typed placeholders.

Emails, phone and identity numbers and street addresses have a form of their
own. Names don't: a word pair is a person if its words disclose persons. The
corpus says how strongly they do. Persons stand at first where language itself
puts them (after a title, as an initial, beside verbs of speech, in a
signature). The words of such names tell which other surroundings hold persons
more often than not, whatever the corpus writes there: these places are learnt
and taken from then on. For every word that stands in a person's place, the
pointwise information between the word and such a place, over all occurrences
of the word in the corpus, is its disclosure; words above the threshold are
generalised to the placeholder, wherever they make up a name; others stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.tables import cut, spread


@dataclass(frozen=True)
class Disclosure:
    """bits: information about a person from which a word is generalised; away_rows: times a word must stand in a person's place before it counts elsewhere.

    A surrounding is a person's place if at least place_share of the names in
    it, different ones place_names at least, are made of words that stand
    where language puts persons in sure_share of all names with them, and it has place_part of all such names: so
    no more than 1 / place_part surroundings of each of four kinds. Names in
    any case count there if firm_share of all its occurrences, whatever stands
    beside them, are of such names; else only capitalised ones.
    """

    bits: float = 3.0
    away_rows: int = 3
    place_share: float = 0.6
    place_names: int = 3
    place_part: float = 0.005
    sure_share: float = 0.15
    firm_share: float = 0.3


# Words around persons in English, German and Chinese, titles, kinds of streets. The firm ones hold names in any case, the others only capitalised ones.
FIRM_BEFORE = ["talked to", "talked with", "spoke to", "spoke with", "met with", "signed by", "approved by", "reviewed by", "written by", "reported by", "assigned to", "attendees", "participants", "contact", "regards", "sincerely", "attn", "cc", "author", "assignee", "reviewer", "signed", "gesprochen mit", "mit freundlichen grüßen", "gez."]
BEFORE = [
    "met", "told", "asked", "thanked", "called", "emailed", "phoned", "invited", "hired", "interviewed", "visited", "thanks to", "says", "said that", "dear", "hello", "hi", "named", "married", "colleague", "friend", "manager", "boss", "accountant", "lawyer", "doctor", "nurse", "teacher", "neighbour", "neighbor", "wife", "husband", "brother", "sister", "son", "daughter", "mother", "father", "uncle", "aunt", "cousin",
    "director", "president", "chairman", "secretary", "engineer", "consultant", "ceo", "cto", "cfo", "kollege", "kollegin", "freund", "freundin", "chef", "chefin", "traf", "fragte", "bat", "liebe", "lieber", "hallo",
]
AFTER = ["said", "says", "told", "asked", "wrote", "replied", "answered", "explained", "agreed", "confirmed", "approved", "signed", "noted", "added", "thinks", "believes", "suggested", "reported", "called", "emailed", "phoned", "joined", "lives", "works", "sagte", "sagt", "meinte", "schrieb", "fragte", "antwortete"]
LINKS = r"(?:\s*[:,]|\s+(?:is|was|ist|war))?"
BEFORE_ZH = ["联系人", "负责人", "经办人", "审核人", "申请人", "发件人", "收件人", "参会人", "作者", "姓名"]
GIVEN_ZH = ["交给", "交接给", "转给", "转交给", "发给", "告诉", "通知", "请联系", "感谢", "询问", "拜访", "采访"]
SAYS_ZH = ["说", "表示", "认为", "指出", "告诉"]
AFTER_ZH = [*SAYS_ZH, "确认", "处理", "负责", "审核", "批准", "提交", "跟进", "先生", "女士", "老师", "经理"]
TITLES = ["Dr", "Prof", "Mr", "Mrs", "Ms", "Herr", "Frau"]
STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Terrace", "Court", "Ct", "Crescent", "Boulevard", "Blvd", "Row"]
STREETS_CASED = ["Drive", "Dr", "Way", "Place", "Pl", "Square", "Sq", "Close", "Hill", "Gardens", "Grove", "Park", "Walk", "Mews", "Parade", "Highway"]
STREETS_DE = ["weg", "gasse", "straße", "strasse", "str.", "allee", "platz", "ring", "damm", "ufer", "steig", "rain"]
GB11643_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
GB11643_CODES = "10X98765432"

_NARROW = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x2011: 0x2D, 0x2013: 0x2D}
_SITE = r"(?:(?![到了在是去住至往从于寄搬])[㐀-鿿])"
_L = r"A-Za-zÀ-ɏ"  # letters of words that blanks separate; Han characters need no boundary
_B = rf"0-9{_L}_"
_LATIN = r"[A-Za-zÀ-ɏ]+(?:['’\-][A-Za-zÀ-ɏ]+)*"
_HAN = r"[㐀-鿿]"
_AT = r"(?:@|%40|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)"
_DOT = r"(?:\.|%2e|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_PART = r"[A-Za-z0-9À-ɏ_+\-]+"
EMAIL = re.compile(rf"(?<![{_B}+\-]){_PART}(?:{_DOT}{_PART})*{_AT}(?:[A-Za-z0-9À-ɏ\-]+{_DOT})+[A-Za-zÀ-ɏ]{{2,}}(?![{_B}])", re.I)
_EMAIL_HINT = re.compile(r"@|%40|\bdot\b|\bat[\])}]", re.I)
ID_18 = re.compile(r"(?<![\dA-Za-z])\d(?:[ \-]?\d){16}[ \-]?[\dXx](?![\dA-Za-z])")
ID_SHORT = re.compile(rf"(?<![{_B}\-])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}} \d{{2}} \d{{4}}|[A-Za-z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-Da-d])(?![{_B}\-])")
PHONE = re.compile(
    rf"(?<![{_B}.\-+])(?:"
    r"\+\d{1,3}[ \-.]?(?:\(0\))?(?:\(?\d{1,5}\)?[ \-.]?){1,5}\d{2,}"  # international
    r"|00\d{2}[ \-.]?(?:\(0\))?\d{2,5}(?:[ \-.]?\d{3,8}){1,2}"
    r"|(?:1[ \-.])?(?:\(\d{3}\) ?|\d{3}[ \-.])\d{3}[ \-.]\d{4}"  # North American plan
    r"|(?:86[ \-]?)?1[3-9]\d(?:[ \-]?\d{4}){2}"  # Chinese mobile
    r"|\(0\d{2,4}\)[ \-]?\d{3,4}[ \-]?\d{4}|0\d{2,3}-\d{7,8}"  # area code of a land line
    r"|0\d{4}[ \-]\d{6}|0\d{4}[ \-]\d{3}[ \-]\d{3}|0\d{2}[ \-]\d{4}[ \-]\d{4}|0\d{3}[ \-]\d{3}[ \-]\d{4}|07\d{9}"  # British
    rf")(?:,? ?(?:ext\.?|x) ?\d{{1,5}})?(?![{_B}\-])"
)
_CITY = rf"(?:, {_LATIN}(?: \d{{5}})?)?"
_FLAT = r"(?:(?:Flat|Unit|Apt\.?|Suite|Room) #?\w{1,5}, )?"
_INNER = r"(?:,? ?(?:(?:Apt\.?|Suite|Unit|Flat|Room) |#)\w{1,5})?"
ADDRESS = [
    re.compile(rf"{_FLAT}(?<![{_B}.\-])\d{{1,5}}[A-Za-z]?,? {_LATIN} (?:{'|'.join(STREETS)})(?![{_B}\-])\.?{_INNER}{_CITY}", re.I),
    re.compile(rf"{_FLAT}(?<![{_B}.\-])\d{{1,5}}[A-Za-z]?,? (?:[A-Z][\w'’\-]+ ){{1,3}}(?:{'|'.join(STREETS + STREETS_CASED)})(?![{_B}\-])\.?{_INNER}{_CITY}"),
    re.compile(rf"(?<![{_B}])[{_L}]{{3,}}(?:{'|'.join(map(re.escape, STREETS_DE))}) \d{{1,4}}[a-z]?(?![{_B}]|[\-.]\d)(?:, \d{{5}} {_LATIN})?", re.I),
    re.compile(rf"(?<![{_B}])(?:am|an der|an den|im|in der|zum|zur|auf dem|auf der|unter den) {_LATIN} \d{{1,4}}[a-z]?, \d{{5}} {_LATIN}", re.I),
    re.compile(rf"(?:{_SITE}{{2,4}}(?:省|市|州))*(?:{_SITE}{{1,4}}(?:区|县|镇|乡))*{_SITE}{{1,5}}(?:路|街|巷|大道|道|弄|胡同)\s?(?:\d+|[一二三四五六七八九十百零〇]+)\s?(?:号|弄)(?:\s?\d+\s?(?:号楼|栋|室|单元|楼))*"),
]
# What a text must hold for a pattern of ADDRESS to match: one of these words, or the pattern.
_ADDRESS_HINTS = [
    frozenset(w.lower() for w in STREETS), frozenset(w.lower() for w in STREETS + STREETS_CASED), re.compile(rf"(?:{'|'.join(map(re.escape, STREETS_DE))}) \d", re.I), re.compile(r"\d, \d{5} "), re.compile(r"[路街巷道弄同]\s?[\d一二三四五六七八九十百零〇]"),
]
_TITLE_WORDS = frozenset(t.lower() for t in TITLES)
_TITLE = rf"(?:(?:{'|'.join(TITLES)})\.? )?"
_PERSON = rf"{_TITLE}(?:({_LATIN}), ?({_LATIN})|({_LATIN}) (?:[A-Za-zÀ-ɏ]\. )?({_LATIN})|[A-Za-zÀ-ɏ]\. ?({_LATIN}))"
_UP = r"[A-ZÀ-ÖØ-Þ]"
_CAPITAL = rf"{_TITLE}(?:({_UP}{_LATIN}), ({_UP}{_LATIN})(?! {_UP}{_LATIN})|({_UP}{_LATIN}) (?:{_UP}\. )?({_UP}{_LATIN})|{_UP}\. ?({_UP}{_LATIN}))"
_or = lambda words: "|".join(map(re.escape, words))
_ENDS = re.compile(rf"(?<![{_B}.\-@+%]){_PERSON}\Z", re.I)
_ENDS_CAPITAL = re.compile(rf"(?<![{_B}.\-@+%]){_CAPITAL}\Z")
CUED_ZH = [
    re.compile(rf"(?:(?:{_or(BEFORE_ZH)})[：:]|{_or(GIVEN_ZH)}|本{_HAN}{{1,2}}由)\s?({_HAN}{{2,4}}?)(?=[，,。；;、\s]|{_or(AFTER_ZH)}|$)"),
    re.compile(rf"(?<!{_HAN})({_HAN}{{2,4}}?)(?={_or(SAYS_ZH)})"),
]
#: Looks ahead, so that a name is tried at every word: "Yesterday Jane Holt" has two readings.
AWAY = re.compile(rf"(?<![{_B}.\-@+%])(?={_CAPITAL}(?![{_B}@]))")
_TITLED = re.compile(rf"(?<![{_B}])(?:{_or(TITLES)})\.? (?={_PERSON}(?![{_B}]))", re.I)
_RUN = re.compile(rf"{_HAN}{{2,4}}")
_HINT_ZH = re.compile(rf"{_or([*BEFORE_ZH, *GIVEN_ZH, *SAYS_ZH])}|由")
#: Words and runs of marks: what surroundings are made of.
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d")

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
SPAN = "struct<a:int,b:int,kind:string,terms:array<string>,cued:boolean>"
_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("terms", pa.list_(pa.string())), ("cued", pa.bool_())]))


def _narrow(text: str) -> str:
    """text with full-width characters as plain ones, code point by code point."""
    return text if text.isascii() else text.translate(_NARROW)


def checked_18(text: str) -> bool:
    """Whether an identity number of 18 characters has the check character of GB 11643."""
    s = re.sub(r"[ \-]", "", text).upper()
    return len(s) == 18 and GB11643_CODES[sum(int(d) * w for d, w in zip(s, GB11643_WEIGHTS, strict=False)) % 11] == s[17]


def _terms(words: list[str]) -> list[str]:
    """The words of a name as the corpus counts them: lower case, parts of hyphenated ones apart."""
    return [p for w in words for p in re.findall(r"[^\W\d_]+", w.lower()) if len(p) > 1]


def _persons(m: re.Match, at: int) -> Iterator[tuple]:
    """a, b, kind, terms of a match of _PERSON in a text that begins at `at`; a title stays outside, an initial doesn't.

    "As W. Holt" may be a name with a middle initial or one after a word: both are candidates.
    """
    found = [i for i in range(1, 6) if m.group(i)]
    first, last = min(map(m.start, found)), max(map(m.end, found))
    dot = m.string.find(".", first, last) if found == [3, 4] else m.string.rfind(".", 0, first) if found == [5] else -1
    if found != [5]:
        yield at + first, at + last, "person", _terms([m.group(i) for i in found])
    if dot >= 0:
        yield at + dot - 1, at + last, "person", _terms([m.group(found[-1])])


def _surrounding(tokens: str) -> tuple[str, str]:
    """A check that no word goes on before the tokens, and a pattern of the tokens, in any case."""
    return rf"(?<![{_B}])" if tokens[0].isalnum() else "", r"\s*".join(f"(?i:{re.escape(x)})" for x in tokens.split())


class Cues:
    """Where persons stand: patterns by the word that a text must hold for them to be tried."""

    def __init__(self, learnt: frozenset[tuple[str, str, bool]] = frozenset(), families: frozenset[str] = frozenset()) -> None:
        """learnt: (before or after, tokens joined by blanks, whether for names in any case); families: first characters of Chinese names."""
        self.before, self.after, self.marks = {}, {}, []
        self.families = re.compile(f"[{''.join(sorted(families))}](?={_HAN})") if families else None
        for words, person, flags in ((FIRM_BEFORE, _PERSON, "(?i:%s)"), (BEFORE, _CAPITAL, "(?i:%s)")):
            for w in words:
                self._put(self.before, w, rf"(?<![{_B}]){flags % re.escape(w)}{LINKS}\s+(?={person}(?![{_B}]))", re.I if person is _PERSON else None)
        for w in AFTER:
            self._put(self.after, w, rf"(?<=[{_L}])\s+(?i:{re.escape(w)})(?![{_B}])", None)
        for w in AFTER_ZH:
            self._put(self.after, w, rf"(?<=[{_L}])\s?{w}", re.I)
        self._put(self.before, "由", rf"(?:(?:{_or(BEFORE_ZH)})[：:]|{_or(GIVEN_ZH)}|本{_HAN}{{1,2}}由)\s?(?={_PERSON}(?![{_B}]))", re.I)
        for mark in (*GIVEN_ZH, *BEFORE_ZH):
            self.marks.append((mark, True, self.marks[-1][2]))
        for side, tokens, firm in sorted(learnt):
            person, flags = (_PERSON, re.I) if firm else (_CAPITAL, None)
            edge, joined = _surrounding(tokens)
            if side == "before":
                self._put(self.before, tokens, rf"{edge}{joined}\s*(?={person}(?![{_B}]))", flags)
            else:
                self._put(self.after, tokens, rf"(?<=[{_L}])\s*{joined}" + (rf"(?![{_B}])" if tokens[-1].isalnum() else ""), flags)

    def _put(self, at: dict, tokens: str, pattern: str, flags: int | None) -> None:
        """Han words are part of longer runs and marks of none, so these are looked for as they are."""
        words = [w for w in _WORD.findall(tokens.lower()) if w < "\u3400"]
        made = re.compile(pattern, flags or 0), flags
        if words:
            at.setdefault(max(words, key=len), []).append(made)
        else:
            self.marks.append((max(tokens.split(), key=len), at is self.before, made))

    def persons(self, t: str, words: set[str]) -> Iterator[tuple]:
        """The persons of a text of these words (in lower case) in a person's place; where only capitalised names count, not those of texts all in capitals."""
        before = [p for w in words & self.before.keys() for p in self.before[w]]
        after = [p for w in words & self.after.keys() for p in self.after[w]]
        for mark, first, made in self.marks:
            if mark in t:
                (before if first else after).append(made)
        before, after = {p[0].pattern: p for p in before}.values(), {p[0].pattern: p for p in after}.values()
        for m in () if words.isdisjoint(_TITLE_WORDS) else _TITLED.finditer(t):
            yield from _persons(m, 0)
        for pattern, flags in sorted(before, key=lambda p: p[0].pattern):
            for m in pattern.finditer(t):
                yield from (s for s in _persons(m, 0) if flags or not t[s[0] : s[1]].isupper())
        for pattern, flags in sorted(after, key=lambda p: p[0].pattern):
            for m in pattern.finditer(t):
                start = m.start()
                for _ in range(5):  # a title, two names and an initial are four words at most, however long
                    if start > 0:
                        start = t.rfind(" ", 0, start) if t.rfind(" ", 0, start) >= 0 else 0
                if n := (_ENDS_CAPITAL if flags is None else _ENDS).search(t[start : m.start()]):
                    yield from (s for s in _persons(n, start) if flags is not None or not t[s[0] : s[1]].isupper())


def candidates(text: str, cues: Cues | None = None) -> list[tuple]:
    """(a, b, kind, terms, cued) of every candidate, in code points; they don't overlap but for readings of one name; earlier kinds win.

    Of a cued Chinese name the family name is the term; away from cues, two to
    four characters that begin with one of the families are one as a whole.
    """
    cues = cues or Cues()
    t = _narrow(text)
    words = set(_WORD.findall(t.lower()))
    out: list[tuple] = []

    def put(*spans: tuple, cued: bool = True) -> None:
        """Adds those that overlap nothing from before."""
        out.extend([(*s, cued) for s in spans if all(s[1] <= x[0] or s[0] >= x[1] for x in out)])

    if _EMAIL_HINT.search(t):
        for m in EMAIL.finditer(t):
            put((*m.span(), "email", []))
    if _DIGITS.search(t):
        for pattern, hint in zip(ADDRESS, _ADDRESS_HINTS, strict=True):
            if not words.isdisjoint(hint) if isinstance(hint, frozenset) else hint.search(t):
                for m in pattern.finditer(t):
                    put((*m.span(), "address", []))
        for m in ID_18.finditer(t):
            if checked_18(m.group()):
                put((*m.span(), "id_number", []))
        for m in ID_SHORT.finditer(t):
            put((*m.span(), "id_number", []))
        for m in PHONE.finditer(t):
            if 7 <= sum(c.isdigit() for c in m.group()) <= 18:
                put((*m.span(), "phone", []))
    # readings of one place may overlap each other: "by Jane Holt said" has one from either side
    put(*{s[:2]: s for s in cues.persons(t, words)}.values())
    if _HINT_ZH.search(t):
        for pattern in CUED_ZH:
            for m in pattern.finditer(t):
                put((*m.span(1), "person", [m.group(1)[0]]))
    away = {s[:2]: s for m in AWAY.finditer(t) for s in _persons(m, 0)}
    if cues.families:
        for m in cues.families.finditer(t):
            run = _RUN.match(t, m.start()).group()
            away |= {(m.start(), m.start() + n): (m.start(), m.start() + n, "person", [run[:n]]) for n in range(2, len(run) + 1)}
    put(*away.values(), cued=False)
    return out


_surely: Cues | None = None


def _sighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, terms, sure, around of every capitalised name: its words, whether it stands where language puts persons, and its surroundings (side and tokens)."""
    global _surely
    _surely = _surely or Cues()
    for b in batches:
        out = []
        for text in b.column(0).to_pylist():
            if not text:
                continue
            t = _narrow(text)
            found = {s[:2]: s for m in AWAY.finditer(t) for s in _persons(m, 0) if s[3] and not t[s[0] : s[1]].isupper()}
            if not found:
                continue
            sure = {s[:2] for s in _surely.persons(t, set(_WORD.findall(t.lower())))}
            tokens = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(t)]
            starts, ends = [x[0] for x in tokens], [x[1] for x in tokens]
            for (a, e), s in found.items():
                i, j = bisect_right(ends, a), bisect_left(starts, e)
                around = [f"before {' '.join(x[2] for x in tokens[i - n : i])}" for n in (1, 2) if i >= n] + [f"after {' '.join(x[2] for x in tokens[j : j + n])}" for n in (1, 2) if j + n <= len(tokens)]
                out.append((" ".join(s[3]), s[3], (a, e) in sure or t[e - 1] != "." and "." in t[a:e], [x for x in around if len(x) < 60]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())))], ["name", "terms", "sure", "around"])


def places(df: DataFrame, text: str, rule: Disclosure) -> frozenset[tuple[str, str, bool]]:
    """The surroundings (before or after, tokens, firm) that the corpus shows to be a person's place; of each side and length 1 / rule.place_part at most."""
    seen = cut(spread(df.select(F.col(text).alias("_text"))).mapInArrow(_sighted, "name string, terms array<string>, sure boolean, around array<string>"))
    known = seen.select("sure", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if("sure").alias("places"), F.count("*").alias("n")).filter((F.col("places") > 0) & (F.col("places") >= rule.sure_share * F.col("n"))).select("term")
    names = seen.select("name", "terms").distinct()
    all_known = names.select("name", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(known, "term").groupBy("name").agg((F.count("*") == F.first("n")).alias("known"))
    each = seen.select("name", F.explode("around").alias("around")).join(all_known, "name", "left")
    told = F.coalesce("known", F.lit(False))
    total = seen.select(F.count_if("sure").alias("total"))  # one row
    ways = each.groupBy("around").agg(F.count("*").alias("n"), F.count_if(told).alias("persons"), F.countDistinct(F.when(told, F.col("name"))).alias("names"))
    good = ways.filter((F.col("persons") >= rule.place_share * F.col("n")) & (F.col("names") >= rule.place_names)).crossJoin(F.broadcast(total))
    good = good.filter(F.col("persons") >= rule.place_part * F.col("total"))
    counts = {tuple(r.around.split(" ", 1)): r.persons for r in good.select("around", "persons").collect()}
    tokens = sorted({t for _, t in counts})
    keys = {t: max((w for w in _WORD.findall(t) if w < "\u3400"), key=len, default=None) for t in tokens}

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {t: re.compile("".join(_surrounding(t)) + (rf"(?![{_B}])" if t[-1].isalnum() else "")) for t in tokens}
        by, n = {w: [t for t in tokens if keys[t] == w] for w in set(keys.values())}, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    low = _narrow(text)
                    for w in [None, *(by.keys() & set(_WORD.findall(low.lower())))]:
                        for t in by.get(w, ()):
                            n[t] += len(made[t].findall(low))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["tokens", "n"])

    whole = {r.tokens: r.n for r in spread(df.select(F.col(text).alias("_text"))).mapInArrow(occurring, "tokens string, n bigint").groupBy("tokens").agg(F.sum("n").alias("n")).collect()} if tokens else {}
    return frozenset((side, t, persons >= rule.firm_share * whole.get(t, persons)) for (side, t), persons in counts.items())


def _names_zh(df: DataFrame, text: str, rule: Disclosure) -> DataFrame:
    """term, slots: the whole Chinese names that stand in a person's place rule.away_rows times or more, and how often; written."""
    t = F.translate(text, "：，；\u3000\xa0", ":,;  ")
    found = F.concat(*[F.regexp_extract_all(t, F.lit(c.pattern), F.lit(1)) for c in CUED_ZH])
    return cut(df.filter(F.col(text).rlike(_HINT_ZH.pattern)).select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("slots")).filter(F.col("slots") >= rule.away_rows))


def _candidates(df: DataFrame, keep: list[str], text: str, names: DataFrame, rule: Disclosure) -> DataFrame:
    """uid, the columns to keep and spans, one row per row of df, written. Of names (see _names_zh) the driver gets the first characters."""
    families = frozenset(r[0] for r in names.select(F.substring("term", 1, 1)).distinct().collect())
    learnt = places(df, text, rule)
    rows = df.select(*keep, F.col(text).alias("_text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = Cues(learnt, families)
        for b in batches:
            made = [[dict(zip(("a", "b", "kind", "terms", "cued"), c, strict=True)) for c in candidates(t, cues)] if t else [] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(made, _ARROW)], [*keep, "spans"])

    return cut(spread(rows).mapInArrow(run, ", ".join([*fields, f"spans array<{SPAN}>"])).withColumn("uid", F.monotonically_increasing_id()))


def disclosing_terms(made: DataFrame, df: DataFrame, text: str, rule: Disclosure) -> DataFrame:
    """term, slots: the words whose information about a person's place reaches rule.bits, and how often they stand in one.

    With p = (occurrences of the word in such places) / (all its occurrences)
    and q the same ratio over all words, the information is log2(p / q). All
    texts are counted.
    """
    slots = made.select(F.explode("spans").alias("s")).filter("s.kind = 'person' AND s.cued").select(F.explode("s.terms").alias("term")).groupBy("term").agg(F.count("*").alias("slots"))
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zà-ɏ]+|[\u3400-\u9fff]"), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    q = words.agg(F.sum("n").alias("words")).crossJoin(slots.agg(F.sum("slots").alias("places")))  # one row each
    p = F.least(F.lit(1.0), F.col("slots") / F.coalesce("n", "slots"))
    scored = slots.join(words, "term", "left").join(F.broadcast(q), how="cross")
    return scored.filter(F.log2(p * F.col("words") / F.col("places")) >= rule.bits).select("term", "slots")


def find(df: DataFrame, keep: list[str], text: str, rule: Disclosure = Disclosure()) -> DataFrame:
    """uid, the columns to keep, and a, b, kind of every item of personal data (code points [a, b) of the text), a row each.

    Null and empty texts have none; repeated rows stay repeated (uid tells
    them apart); texts are searched whole. A name counts if each of its words
    discloses persons; away from places of persons only if each does so
    rule.away_rows times or more. A Chinese name there counts if its family
    name discloses persons and the whole name stood in such places that often.
    """
    names = _names_zh(df, text, rule)
    made = _candidates(df, keep, text, names, rule)
    return _found(made, df, keep, text, rule, names)


def _found(made: DataFrame, df: DataFrame, keep: list[str], text: str, rule: Disclosure, names_zh: DataFrame) -> DataFrame:
    each = made.select("uid", *keep, F.explode("spans").alias("s"))
    sure = each.filter("s.kind != 'person'").select("uid", *keep, "s.a", "s.b", "s.kind")
    names = made.select("uid", F.posexplode("spans").alias("at", "s")).filter("s.kind = 'person' AND size(s.terms) > 0")
    words = names.select("uid", "at", "s.cued", F.size("s.terms").alias("size"), F.explode("s.terms").alias("term"))
    terms = cut(disclosing_terms(made, df, text, rule))
    terms = terms.unionByName(names_zh.join(terms.select(F.col("term").alias("family")), F.substring("term", 1, 1) == F.col("family")).drop("family"))
    told = words.join(terms, "term").filter(F.col("cued") | (F.col("slots") >= rule.away_rows))
    told = told.groupBy("uid", "at").agg((F.count("*") == F.first("size")).alias("all")).filter("all").select("uid", "at")
    persons = made.select("uid", *keep, F.posexplode("spans").alias("at", "s")).join(told, ["uid", "at"])
    return sure.unionByName(persons.select("uid", *keep, "s.a", "s.b", "s.kind"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, spans in zip(b.column("_text").to_pylist(), b.column("items").to_pylist(), strict=True):
            if t and spans:
                done, at = [], len(t)
                for s in sorted(spans, key=lambda s: (-s["b"], s["a"])):
                    if s["b"] <= at:
                        done += [t[s["b"] : at], PLACEHOLDERS[s["kind"]]]
                        at = s["a"]
                t = t[:at] + "".join(reversed(done))
            out.append(t)
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 2)], pa.array(out, pa.string())], names=[*b.schema.names[:-2], "sanitised"])


def sanitise(df: DataFrame, keep: list[str], text: str, rule: Disclosure = Disclosure()) -> DataFrame:
    """The columns to keep and `sanitised`: the text with each item of find() as its placeholder, the rest untouched.

    One row per row of df; a null text stays null. Of readings that overlap
    the longer one that ends last is taken.
    """
    names = _names_zh(df, text, rule)
    made = _candidates(df.withColumn("_whole", F.col(text)), [*keep, "_whole"], text, names, rule)
    items = _found(made.drop("_whole", *keep), df, [], text, rule, names).groupBy("uid").agg(F.collect_list(F.struct("a", "b", "kind")).alias("items"))
    rows = made.join(items, "uid", "left").select(*keep, F.col("_whole").alias("_text"), "items")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.mapInArrow(_replace, ", ".join([*fields, "sanitised string"]))
