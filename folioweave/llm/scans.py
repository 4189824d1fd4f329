"""Problem 1: repair text from scanned pages.

Layout first: hard-wrapped records are told from others by their line lengths, and their page numbers and
running heads are taken out. The lexicon counts words and word pairs of all other records. Words of scanned
records that the lexicon lacks meet it in a symmetric-delete index: both sides give their form with confusable
characters drawn together, and that form with one character left out; equal keys make candidates. Weighted
edit distance with confusion pairs, frequency and the neighbouring words pick the repair. Words broken at
line ends are joined, with or without their hyphen, as the lexicon has them. All counting and matching is
relational and shuffled on words; nothing of it is collected or broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from ._frames import arrow_map, once

# --- fixed values -----------------------------------------------------------------------------------------
#: Ends of sentences, closing marks after them, and hyphens that break words.
ENDS = ".!?。！？"
CLOSERS = "\"'”’»）)]】」』"
HYPHENS = "-­¬‐‑"
#: Small words of titles that may stay in lower case.
SMALL = frozenset("a an and at by for from in of on or the to with von und der die das des dem den im zu de la le les du et en au aux y del los las el con para por".split())
#: Confusable characters, drawn together into one each; pairs first.
PAIRS = [("rn", "m"), ("nn", "m"), ("iii", "m"), ("vv", "w"), ("ii", "u"), ("li", "u"), ("cl", "d"), ("ci", "d"), ("lc", "k"), ("ri", "n")]
SINGLES = {
    "0": "o", "o": "o", "q": "o", "1": "l", "l": "l", "i": "l", "|": "l", "!": "l", "¡": "l", "í": "l", "ì": "l", "ï": "l", "î": "l", "j": "l", "t": "l", "f": "l", "r": "l",
    "5": "s", "s": "s", "$": "s", "8": "b", "b": "b", "h": "b", "6": "b", "@": "a", "a": "a", "4": "a", "e": "e", "c": "e", "3": "e", "é": "e", "è": "e", "€": "e", "9": "g", "g": "g",
    "2": "z", "z": "z", "7": "t", "u": "u", "v": "u", "n": "u", "ü": "u", "ä": "a", "á": "a", "à": "a", "â": "a", "ö": "o", "ó": "o", "ô": "o", "ñ": "u", "ç": "e", "%": "o",
}
#: Costs: a confusable pair or character, an accent, any other edit.
CONFUSED, OTHER = 0.3, 1.0
#: Longer forms are met by confusable characters only.
LONG_FORM = 60
#: A word of the lexicon is doubted if one that it may be a misreading of is so many times as frequent.
DWARFED = 200
# ----------------------------------------------------------------------------------------------------------

_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUM = rf"(?:\d{{1,5}}|{_ROMAN})"
PAGE = re.compile(
    rf"[\s\W_]*(?:(?:page|pages|pg|pp|p|seite|s|página|pagina|pág|pag|blatt|folio|no|nr|n°|第)[\s.:]*)?{_NUM}"
    rf"(?:\s*(?:/|\||of|von|de|sur|aus|共|至|-|–)\s*(?:第|共)?\s*{_NUM})?\s*(?:页|頁|页共)?[\s\W_]*",
    re.I,
)
WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_HAN = re.compile(r"[㐀-鿿]")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBERED = re.compile(rf"(?:{_NUM}\s{{2,}}\S.*|.*\S\s{{2,}}{_NUM}|\S?\d+(?:\.\d+)+\.?\s+\S.*)", re.I)
_PARTED = re.compile(r"\S\s*(?: [|—–·•] |\s{2,}[|—–·•-]\s{1,}|\s{3,})\s*\S")
_STOPS = re.compile(r"[.!?。！？,，;；:：、（）()]")
_STRIP = ".,;:?()[]{}\"“”„«»…'’‘—–·*#>~¿。，；：？！（）"


def closed(s: str) -> bool:
    """Whether a line ends a sentence."""
    s = s.rstrip().rstrip(CLOSERS)
    return bool(s) and s[-1] in ENDS


def is_page_number(s: str) -> bool:
    return bool(s) and len(s) <= 30 and PAGE.fullmatch(s) is not None and any(c.isalnum() for c in s) and not (s[-1] in ENDS and not any(c.isdigit() for c in s))


def _title(s: str) -> int:
    """0 no title, 1 perhaps (one or two words in title case), 2 surely."""
    if _STOPS.search(s.replace("|", " ").rstrip(".")):
        return 0
    words = [w for w in re.split(r"[\s|—–·•-]+", s) if _LETTER.search(w)]
    if not words or any(w[0].islower() and w.lower() not in SMALL for w in words if not w[0].isdigit()):
        return 0
    big = [w for w in words if w.lower() not in SMALL]
    if not big:
        return 0
    if len(words) >= 2 and all(w == w.upper() for w in words if w.upper() != w.lower()) and sum(map(len, words)) > 5 and not _HAN.search(s):
        return 2
    return 2 if len(words) >= 3 and any(not w[0].isupper() for w in words) or len(big) >= 4 else 1


def _sure_head(s: str) -> bool:
    """A line in the form of a running head: titles parted by marks, or with a page or section number."""
    if closed(s) or s[-1] in HYPHENS:
        return False
    bare = re.sub(r"\d+(?:\.\d+)+", "", s)
    return not _STOPS.search(bare) and bool(_NUMBERED.fullmatch(s) or _PARTED.search(s))


class Page:
    """Layout of one record: scanned or not, and for each line one of B body, P page number, H running head,
    M perhaps a running head, or '' for a blank one."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.kind = [""] * len(self.lines)
        self.scanned = False
        full = [i for i, s in enumerate(self.lines) if s.strip()]
        if len(full) < 2:
            return
        strips = {i: self.lines[i].strip() for i in full}
        pages = {i for i in full if is_page_number(strips[i])}
        body = [i for i in full if i not in pages]
        if not body or any("\t" in self.lines[i] for i in body):
            return
        sure = {i for i in body if _sure_head(strips[i])}
        plain = [i for i in body if i not in sure]
        if not plain:
            return
        held = set(plain)
        near = [(i, j) for i, j in zip(plain, plain[1:]) if j == i + 1 and i in held]
        han = sum(len(_HAN.findall(strips[i])) for i in plain) * 2 > sum(len(strips[i]) for i in plain)
        width = max(len(strips[i]) for i in plain if not (han and not _HAN.search(strips[i])) or len(plain) == 1)
        if width > 160:
            return
        self.han, self.width = han, width

        def flows(i: int, j: int) -> bool:
            """Whether line i is as full as a wrapped line before j must be."""
            first = 1 if han else len(strips[j].split()[0])
            return len(strips[i]) + (0 if han else 1) + first >= width - 2 or strips[i][-1] in HYPHENS and len(strips[i]) >= width - 6

        wrapped = [(i, j) for i, j in near if flows(i, j)]
        open_ = [i for i, _ in wrapped if not closed(strips[i])]
        rows = sum(1 for i in body if re.search(r" \| .* \| |^[-*•] |^ {4,}\S|[=\[\]{}]", self.lines[i]) and not _PARTED.search(strips[i]) or re.search(r"\w \| [\d.]+ \| \w", strips[i]))
        if rows * 2 > len(body):
            return
        if width >= 14 and wrapped and len(wrapped) >= 0.5 * len(near) and open_ and len(open_) * 2 >= len(wrapped):
            self.scanned = True
        elif pages and len(body) >= 1 and any(closed(strips[i]) or len(strips[i]) > 30 for i in body):
            self.scanned = True
        if not self.scanned:
            return
        for i in pages:
            self.kind[i] = "P"
        flow = [len(strips[i]) for i, _ in wrapped]
        fill = max(flow) if flow else width
        slack = 2 if han else 16
        last = body[-1]
        for n, i in enumerate(body):
            s = strips[i]
            self.kind[i] = "B"
            if closed(s) or s[-1] in HYPHENS or s[-1] in ",，;；:：、":
                continue
            title = 0 if _HAN.search(s) else _title(s)
            if _HAN.search(s) and not _STOPS.search(s):
                title = 1
            short = len(s) < fill - slack
            indent = self.lines[i][:1].isspace() or self.lines[i][-1:].isspace()
            before = body[n - 1] if n else None
            apart = (i == 0 or not self.lines[i - 1].strip() or self.kind[i - 1] == "P" or i - 1 in pages) and (i + 1 >= len(self.lines) or not self.lines[i + 1].strip() or i + 1 in pages)
            beside = i - 1 in pages or i + 1 in pages or i and self.kind[i - 1] in ("H", "M")
            foreign = _HAN.search(s) is not None and not han
            gap = i == 0 or not self.lines[i - 1].strip() or i + 1 < len(self.lines) and not self.lines[i + 1].strip()
            if i in sure or title == 2 and (short or indent or beside or gap):
                self.kind[i] = "H"
            elif title and (indent or beside or foreign):
                self.kind[i] = "H"
            elif short and i != last and n + 1 < len(body):
                # a wrapped line is never short inside a sentence; before a break the sentence must have ended
                self.kind[i] = "H"
            elif title and before is not None and before == i - 1 and closed(strips[before]) and short:
                self.kind[i] = "H"
            elif title and (apart or i == last) and short:
                self.kind[i] = "M"

    def words(self, heads=frozenset()):
        """Body tokens in reading order, hyphenation joined: (form, hyphen parts or None, last of text?)."""
        out, carry = [], None
        body = [s for s, k in zip(self.lines, self.kind) if k == "B" or k == "M" and s.strip() not in heads]
        for n, s in enumerate(body):
            toks = s.split()
            if carry is not None and toks:
                if toks[0][:1].isalpha() or len(toks[0]) > 1 and toks[0][1].isalpha():
                    out.append((carry + "\0" + toks[0], True))
                    toks = toks[1:]
                    carry = None
                    if not toks:
                        continue
                else:
                    out.append((carry, False))
                    carry = None
            last = toks[-1] if toks else ""
            if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalnum() and n + 1 < len(body):
                carry = last[:-1]
                toks = toks[:-1]
            out += [(t, False) for t in toks]
        if carry is not None:
            out.append((carry, False))
        return out


def core(tok: str) -> str:
    """A token in lower case without surrounding punctuation; misread marks inside or around it stay."""
    s = tok.strip(_STRIP).lower().replace("’", "'")
    while s and s[-1] in "!" + _STRIP:
        s = s[:-1]
    if s[:1] == "¡" and tok.lstrip(_STRIP)[1:2].isupper():
        s = s[1:]
    return s


def head_parts(line: str) -> list[str]:
    """The titles of a running head, without numbers and case."""
    s = re.sub(r"\d+(?:\.\d+)*", " ", line.lower())
    parts = [re.sub(r"[\W_]+", " ", p).strip() for p in re.split(r"\s[|—–·•-]+\s|\s{3,}", s)]
    return [p for p in parts if len(p) > 2]


def canonical(w: str) -> str:
    for a, b in PAIRS[:6]:
        w = w.replace(a, b)
    return "".join(SINGLES.get(c, c) for c in w)


def _drawn(w: str) -> str:
    return "".join(SINGLES.get(c, c) for c in w)


def _rewritten(w: str, times: int) -> list[set[str]]:
    """The forms of a word with 0, 1, ... `times` of its pairs, at any places, written as the one character."""
    out, last = [{w}], {(w, 0)}
    for _ in range(times):
        last = {(x[:i] + b + x[i + len(a) :], i + 1) for x, at in last for i in range(at, len(x)) for a, b in PAIRS if x.startswith(a, i)}
        out.append({x for x, _ in last})
    return out


def delete_keys(w: str) -> list[str]:
    """The symmetric-delete keys of a word: its forms with confusable characters drawn together, and those with one
    character left out.

    Whatever confusion made one word of another, one of them can be rewritten at its place, or both are drawn
    together there. Three confusions cost as much as is allowed; with a character left out there is room for one.
    Of forms over LONG_FORM characters, which have too many rewritings, only the two drawn as they stand are keys.
    """
    if len(w) > LONG_FORM:
        return list({canonical(w), _drawn(w)})
    none, one, *more = _rewritten(w, 3)
    bare = {canonical(w), *map(_drawn, none | one)}
    return list({*bare, *(c[:i] + c[i + 1 :] for c in bare for i in range(len(c))), *(_drawn(x) for m in more for x in m)} - {""})


_CONFUSABLE = {}
for _a, _b in PAIRS:
    _CONFUSABLE.setdefault(_a, set()).add(_b)


def distance(read: str, word: str, most: float = 2.0) -> float:
    """Weighted edit distance from what was read to a word: confusable characters and pairs are cheap."""
    n, m = len(read), len(word)
    d = [[math.inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            v = d[i][j]
            if v > most:
                continue
            if i < n and j < m:
                a, b = read[i], word[j]
                c = 0.0 if a == b else CONFUSED if SINGLES.get(a, a) == SINGLES.get(b, b) else OTHER if a.isalpha() else 0.6
                d[i + 1][j + 1] = min(d[i + 1][j + 1], v + c)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], v + OTHER)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], v + OTHER)
            for k in (2, 3):
                if i + k <= n and j < m and word[j] in _CONFUSABLE.get(read[i : i + k], ()):
                    d[i + k][j + 1] = min(d[i + k][j + 1], v + CONFUSED)
                if j + k <= m and i < n and read[i] in _CONFUSABLE.get(word[j : j + k], ()):
                    d[i + 1][j + k] = min(d[i + 1][j + k], v + CONFUSED)
    return d[n][m]


# --- distributed part -------------------------------------------------------------------------------------


def _count(batches):
    """Partial counts of words (prev null) and word pairs of unscanned texts, flushed while small."""
    import pyarrow as pa

    def flush(one, two):
        rows = [(w, None, n) for w, n in one.items()] + [(w, p, n) for (p, w), n in two.items()]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["w", "p", "n"])

    one, two = Counter(), Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if "\n" in t and Page(t).scanned:
                continue
            ws = WORD.findall(t.lower())[1:-1]  # the first and last may be fragments
            one.update(ws)
            two.update(zip(ws, ws[1:]))
        if len(two) > 400_000:
            yield flush(one, two)
            one, two = Counter(), Counter()
    yield flush(one, two)


def lexicon(docs: DataFrame) -> DataFrame:
    """(w, p, n): how often word w stands in unscanned texts, after word p (p null: anywhere)."""
    d = docs.select(F.regexp_replace("t", "’", "'").alias("t")).where("t is not null")
    c = d.mapInArrow(_count, "w string, p string, n long")
    return c.groupBy("w", "p").agg(F.sum("n").alias("n"))


def _events(c: dict) -> dict:
    """What each scanned record holds: (k, src, kind, form, part, prev, next, at)."""
    out = {n: [] for n in ("k", "src", "kind", "form", "part", "prev", "next", "at")}

    def add(k, src, kind, form, part=None, prev=None, nxt=None, at=0):
        for n, v in zip(out, (k, src, kind, form, part, prev, nxt, at)):
            out[n].append(v)

    for k, src, t in zip(c["k"], c["src"], c["t"]):
        page = Page(t)
        if not page.scanned:
            continue
        for i, (s, kind) in enumerate(zip(page.lines, page.kind)):
            if kind == "P":
                add(k, src, "page_number", s.strip())
            elif kind == "H":
                add(k, src, "header", s.strip(), "\n".join(head_parts(s)))
            elif kind == "M":
                for p in head_parts(s):
                    add(k, src, "maybe", s.strip(), p)
        toks = page.words()
        forms = [core(x.replace("\0", "")) for x, _ in toks]
        whole = closed([s for s, q in zip(page.lines, page.kind) if q == "B"][-1]) if "B" in page.kind else True
        for i, ((x, broken), f) in enumerate(zip(toks, forms)):
            if not f or _HAN.search(f) or not _LETTER.search(f):
                continue
            if i == len(toks) - 1 and not whole and not broken:
                continue  # the last word of a cut text may be a fragment
            prev, nxt = forms[i - 1] if i else None, forms[i + 1] if i + 1 < len(forms) else None
            if broken:
                a, b = x.split("\0")
                add(k, src, "hyphen", f, core(a + "-" + b), prev, nxt, i)
            elif len(f) > 1:
                add(k, src, "word", f, None, prev, nxt, i)
    return out


def scan_noise(docs: DataFrame, key: str = "unique_id", text: str = "page_content", source: str = "source", min_count: int = 2) -> DataFrame:
    """(key, kind, fixed, form, at): every repair in scanned records.

    kind: hyphen, misread, header or page_number. `docs` holds one row a key; null keys and texts give no rows.
    A text that is not scanned gives no rows. Equal repairs of a record at several places give one row each
    for hyphen and misread (`at` is the place of the word), and one row for equal lines.
    """
    d = docs.select(F.col(key).alias("k"), F.col(source).alias("src"), F.col(text).alias("t")).where("k is not null and t is not null")
    kd, ks = (docs.schema[c].dataType.simpleString() for c in (key, source))
    lex = materialize(lexicon(d), "lexicon")
    words = lex.where("p is null").select("w", "n")
    pairs = lex.where("p is not null")
    # only records with two lines that touch, or with a short line of a number, can be scanned
    cand = d.where(F.col("t").rlike(r"\S[ \t]*\n[ \t]*\S|(?:^|\n)[^\n]{1,30}(?:\n|$)"))
    ev = materialize(
        arrow_map(cand, _events, f"k {kd}, src {ks}, kind string, form string, part string, prev string, next string, at int"), "scanevents"
    )
    trusted = words.where(F.col("n") >= min_count)
    lines = ev.where("kind in ('page_number', 'header')").select("k", "kind", F.col("form").alias("fixed"), "form", F.lit(0).alias("at"))
    # doubtful heads stay if one of their titles heads another record of the source
    known = ev.where("kind = 'header'").select("src", F.explode(F.split("part", "\n")).alias("part")).distinct()
    more = ev.where("kind = 'maybe'").join(known, ["src", "part"], "left_semi").select("k", F.lit("header").alias("kind"), F.col("form").alias("fixed"), "form", F.lit(0).alias("at"))
    lines = lines.unionByName(more).distinct()
    # broken words: as the lexicon has them
    hy = ev.where("kind = 'hyphen'")
    a, b = words.select(F.col("w").alias("form"), F.col("n").alias("n1")), words.select(F.col("w").alias("part"), F.col("n").alias("n2"))
    hy = hy.join(a, "form", "left").join(b, "part", "left")
    known_hy = F.when(F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0)), F.col("part")).when(F.col("n1").isNotNull(), F.col("form"))
    hy = hy.withColumn("good", known_hy)
    # words that the lexicon lacks, or has so seldom that they may be misread there too
    keys = F.pandas_udf(lambda s: s.map(delete_keys), "array<string>")
    cost = F.pandas_udf(lambda a, b: a.combine(b, distance).astype("float64"), "double")
    index = materialize(trusted.where(F.length("w") > 1).select("w", "n", F.explode(keys("w")).alias("key")), "keys")
    read = ev.where("kind = 'word'")
    held = read.select("form").distinct().join(trusted.select(F.col("w").alias("form"), F.col("n").alias("n0")), "form")
    dwarfed = held.select("form", "n0", F.explode(keys("form")).alias("key")).join(index, "key").where((F.col("form") != F.col("w")) & (F.col("n") >= DWARFED * F.col("n0")))
    dwarfed = dwarfed.select("form", "w", "n0").distinct().where(cost("form", "w") <= 2 * CONFUSED + 0.01)
    sure = held.select("form").join(dwarfed.select("form"), "form", "left_anti")
    odd = read.join(sure, "form", "left_anti")
    occ = odd.select("k", "src", "kind", "form", "prev", "next", "at").unionByName(hy.where("good is null").select("k", "src", "kind", "form", "prev", "next", "at"))
    occ = materialize(occ, "oddwords")
    # a form speaks for itself by what it stands in, so that copies of a page, or pages of one source, count once
    places, sources = F.count_distinct(F.struct("prev", "next")), F.count_distinct(F.coalesce(F.col("src").cast("string"), F.lit("")))
    forms = occ.groupBy("form").agg(F.least(places, sources).alias("seen"))
    asked = forms.select("form", "seen", F.explode(keys("form")).alias("key"))
    met = asked.join(index, "key").where("form <> w").select("form", "seen", "w", "n").distinct()
    met = met.where("n >= 2 * seen").withColumn("cost", cost("form", "w"))
    # what the lexicon has itself gives way to much more frequent look-alikes only
    met = met.join(held, "form", "left").where((F.col("cost") <= 2 * CONFUSED + 0.01) & (F.col("n") >= DWARFED * F.col("n0")) | F.col("n0").isNull()).drop("n0")
    plain = F.length("form") >= 5
    # a plain edit may repair words of five letters or more; shorter ones need confusable characters
    met = met.where(F.when(plain, F.col("cost") <= 1.0).otherwise(F.col("cost") <= 0.61))
    ctx = occ.join(met, "form")
    left, right = pairs.select(F.col("p").alias("prev"), "w", F.col("n").alias("nl")), pairs.select(F.col("p").alias("w"), F.col("w").alias("next"), F.col("n").alias("nr"))
    ctx = ctx.join(left, ["prev", "w"], "left").join(right, ["w", "next"], "left")
    score = F.col("cost") - 0.05 * F.log10("n") - 0.15 * F.log10(1 + F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0)))
    best = ctx.groupBy("k", "kind", "form", "at").agg(F.min_by("w", F.struct(score, "w")).alias("fixed"))
    mis = best.where("kind = 'word'").select("k", F.lit("misread").alias("kind"), "fixed", "form", "at")
    hy2 = hy.select("k", "kind", "form", "at", "good").join(best.where("kind = 'hyphen'").select("k", "form", "at", "fixed"), ["k", "form", "at"], "left")
    hy2 = hy2.select("k", "kind", F.coalesce("good", "fixed", "form").alias("fixed"), "form", "at")
    return lines.unionByName(hy2).unionByName(mis).withColumnRenamed("k", key)


def repaired_text(docs: DataFrame, noise: DataFrame, key: str = "unique_id", text: str = "page_content") -> DataFrame:
    """(key, text, fixes) for every record with noise: continuous paragraphs, and the list of what was changed.

    `noise` is the result of scan_noise on `docs`. Paragraphs end at blank lines after a finished sentence.
    """
    fixes = noise.groupBy(key).agg(F.collect_list(F.struct("kind", "form", "fixed", "at")).alias("fixes"))
    kd = docs.schema[key].dataType.simpleString()

    def run(c):
        texts = []
        for t, fx in zip(c["t"], c["fixes"]):
            heads = {f["form"] for f in fx if f["kind"] in ("header", "page_number")}
            word = {(f["at"], f["form"]): f["fixed"] for f in fx if f["kind"] in ("hyphen", "misread")}
            texts.append(_rebuild(t, heads, word))
        return {"k": c["k"], "text": texts, "fixes": c["fixes"]}

    d = docs.select(F.col(key).alias(key), F.col(text).alias("t")).join(fixes, key).select(F.col(key).alias("k"), "t", "fixes")
    out = arrow_map(d, run, f"k {kd}, text string, fixes array<struct<kind:string,form:string,fixed:string,at:int>>")
    return out.withColumnRenamed("k", key)


def _rebuild(text: str, heads: set, word: dict) -> str:
    page = Page(text)
    toks = page.words(frozenset())
    # walk lines and tokens together, to know where paragraphs end
    joined = iter(enumerate(toks))
    out, para, carry = [], [], False
    body = [(s, i) for i, (s, k) in enumerate(zip(page.lines, page.kind)) if k in ("B", "M")]
    han = getattr(page, "han", False)

    def repaired(i, tok):
        raw = tok.replace("\0", "")
        f = core(raw)
        new = word.get((i, f))
        if new is None:
            return raw
        at = raw.lower().replace("’", "'").find(f)
        if at < 0:
            return new
        if raw[at : at + 1].isupper():
            new = new.upper() if raw[at : at + len(f)].isupper() and len(f) > 1 else new[:1].upper() + new[1:]
        return raw[:at] + new + raw[at + len(f) :]

    for n, (s, i) in enumerate(body):
        count = len(s.split()) - (1 if carry else 0)
        last = s.split()[-1]
        carry = len(last) > 1 and last[-1] in HYPHENS and last[-2].isalnum() and n + 1 < len(body)
        count -= 1 if carry else 0
        if n and _starts_joined(toks, page, n, body):
            count += 1
        got = []
        for _ in range(max(count, 0)):
            step = next(joined, None)
            if step is None:
                break
            got.append(repaired(*[step[0], step[1][0]]))
        if s.strip() not in heads:
            para += got
        after = page.lines[i + 1 : body[n + 1][1]] if n + 1 < len(body) else [""]
        if any(not x.strip() for x in after) and closed(s):
            out.append(("" if han else " ").join(para))
            para = []
    rest = [repaired(i, t[0]) for i, t in joined]
    if para or rest:
        out.append(("" if han else " ").join(para + rest))
    return "\n\n".join(x for x in out if x)


def _starts_joined(toks, page, n, body) -> bool:
    prev = body[n - 1][0].split()[-1]
    first = body[n][0].split()[0]
    return len(prev) > 1 and prev[-1] in HYPHENS and prev[-2].isalnum() and (first[:1].isalpha() or len(first) > 1 and first[1].isalpha())
