"""Problem 6: prompt and response pairs with a defect.

Language posteriors of prompt and response come from the character n-gram naive Bayes model of `language`. Truncation
is told by the likelihood that a text ends where it does: of every occurrence of its last 1, 2, 4 and 6 characters in all
responses, the share that ends one, each order drawn to the shorter one's share. Contexts are counted by hash, only those
that some response ends with, so what is shuffled is small; nothing of it is collected. Forms of empty answers, refusals
and copies are told by rules on whole sentences.
"""

from __future__ import annotations

import difflib
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._frames import arrow_map
from ._text import codes, fold, groups_by_size
from .language import NAMES, Labelled, Model
from .truncation import ITEM, MARKER

# --- fixed values -----------------------------------------------------------------------------------------
#: Placeholders, folded; and templates of them.
PLACEHOLDER = frozenset("null none nil na nan tbd tba todo fixme empty blank undefined unknown xxx xxxx placeholder answer output response 待补充 待定 无 空 暂无 略 未填 未填写 待填写 keine leer vide néant vacío ninguno".split())
TEMPLATE = re.compile(r"\s*(?:<[^<>]{0,40}>|\[[^\[\]]{0,40}\]|\{+[^{}]{0,40}\}+|#+|`+|\"+|_+)\s*")
#: What refuses, by language: (who or what it is about, the refusal).
REFUSAL = (
    (r"\b(?:i|i'm|i'll|my|me)\b|guidelines|policy", r"\b(?:can(?:no|')t|can not|could not|couldn't|won't|will not|(?:not|un)able|must decline|decline|have to decline|refuse|no way of|beyond (?:what|my|the scope)|rather not|do(?:es)? not let me|don't let me|not (?:permitted|allowed|authori[sz]ed|supposed|in a position)|impossible for me)\b.{0,60}?(?:help|assist|answer|respond|repl|discuss|provide|comment|advis|say|share|talk|do that|do this|this for you|\bthis\b|\bthat\b|$)|(?:answer|help|respond|assist|discuss).{0,40}(?:not|never|decline)|beyond (?:what i|my)|decline"),
    (r"", r"(?:无法|不能|不便|不可以|不方便|没有权限|没办法|难以|拒绝|不愿)(?:就此|对此|为您|给您|向您)?.{0,12}?(?:回答|答复|提供|给出|讨论|意见|协助|帮|回应|透露|评论)|超出了?我的?(?:能力|权限|范围)|帮不了|没有权限"),
    (r"\b(?:ich|mir|mich|meine?[rn]?|anfrage|frage)\b", r"\b(?:kann|darf|möchte|werde|könnte|muss|bin|ist)\b.{0,70}?\b(?:nicht|nichts|keine?[nrm]?|ablehnen|verweigern|unmöglich|außerstande)\b|nicht in der lage|außerhalb mein|übersteigt"),
    (r"\b(?:je|me|m'|mes|mon|ma)\b|m'|demande|question", r"\bne (?:peux|puis|suis|dois|saurais|souhaite|me permettent)\b.{0,40}?\b(?:pas|rien|point|autorisé|habilité)|impossible de|pas en mesure|\b(?:refuse|décline|dois refuser|dois décliner)\b|dépasse (?:mes|ce que)"),
    (r"\b(?:yo|me|mi|mis|no)\b|pregunta|petición", r"\bno (?:puedo|podré|debo|estoy|me (?:es posible|está permitid|permiten)|tengo permi|soy capaz|quiero|sé)\b|imposible|debo (?:rechazar|declinar)|(?:rechazo|declino)\b|supera (?:mis|lo que)|fuera de mi"),
)
#: What an apology or a refusal may add to it.
FILLER = re.compile(
    r"sorry|apolog|unfortunately|regret|afraid|understand|anything else|ask (?:somebody|someone|another)|at the moment|other (?:question|channel)|contact|抱歉|对不起|遗憾|不好意思|请咨询|建议您|欢迎|其他问题|谅解|理解|leider|tut mir leid|entschuld|verzeih|verständnis|wenden sie|andere frage|désol|regrett|excus|pardon|compren|autre question|adressez|lo siento|lamento|disculp|perdón|otra pregunta|consulte|comprens",
    re.I,
)
#: What comes before a copied question.
LEAD = re.compile(r"^\W*(?:question|you asked|the question(?: is| was)?|q|prompt|问题|问|题目|您问|frage|sie fragten|la question|vous demandez|pregunta|preguntó|la pregunta)\W+", re.I)
#: How an instruction prescribes a reply, or a language.
REPLY = re.compile(r"(?:reply|answer|respond|say|write|output|return)\s+(?:only|just|exactly)?\s*(?:with)?\s*[:：]\s*(.+)$|只需?(?:要)?(?:回复|回答|答|输出)\s*[:：]?\s*(.+)$|(?:antworte|antworten sie)\s+(?:nur|lediglich)\s*(?:mit)?\s*[:：]\s*(.+)$|(?:réponds|répondez)\s+(?:seulement|uniquement)\s*(?:par)?\s*[:：]\s*(.+)$|(?:responde|responda)\s+(?:solo|sólo|únicamente)\s*(?:con)?\s*[:：]\s*(.+)$", re.I | re.M)
ASKED = re.compile(
    r"\b(?:in|into|auf|ins|en|au|al|to)\s+(?:the\s+)?(?:" + "|".join(w for v in NAMES.values() for w in v.split() if len(w) > 3 and w.isalpha()) + r")\b|(?:用|以|成|为)\s*(?:英|中|汉|德|法|西班牙|西)\s*(?:文|语)|translat|übersetz|tradui|traduc|翻译",
    re.I,
)
# ----------------------------------------------------------------------------------------------------------
_SENT = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_SEP = re.compile(r"\s*[,、;；，\n]\s*")
#: Characters of the contexts, and what the share of a shorter one counts in a longer one's, in occurrences.
ORDERS, DRAWN = (1, 2, 4, 6), 10.0
#: The share before any occurrence: an end that no other text has shows nothing.
UNSEEN = 0.05
#: A response is cut off where its last characters end one less often than this.
RARE_END = 0.01
#: Copies of a response that are left out of the counts it is judged by, at most.
COPIES = 3
#: Bits of the addresses of the filter of contexts.
FILTER = 26
#: A broken escape at the end.
ESCAPE = re.compile(r"(?:%[0-9A-F]{2}%[0-9A-F]?|\\u[0-9a-f]{1,3}|&[a-z]{1,6})$", re.I)
#: A bracket left open at the end.
OPENED = re.compile(r"[(（][^()（）.!?。！？]{0,40}$")
#: A number or place in brackets, after which no stop need follow.
BRACKETS = re.compile(r"\([^()]*\d[^()]*\)$|（[^（）]*\d[^（）]*）$")


def is_empty(o: str | None) -> bool:
    if o is None:
        return True
    f = fold(o)
    return not f or f in PLACEHOLDER or TEMPLATE.fullmatch(o) is not None


def prescribed(instruction: str | None, o: str) -> bool:
    """Whether `o` is the reply that the instruction prescribes."""
    for m in REPLY.finditer(instruction or ""):
        want = fold(next(g for g in m.groups() if g))
        if want and fold(o) == want:
            return True
    return False


def refuses(o: str) -> bool:
    """Whether all sentences of `o`, four at most, decline or go with declining."""
    said, n = False, 0
    for m in _SENT.finditer(o.replace("’", "'")):
        p = m.group().strip()
        if not fold(p):
            continue
        n += 1
        if n > 4:
            return False
        low = p.lower()
        if any(re.search(who, low) and re.search(what, low) for who, what in REFUSAL):
            said = True
        elif not FILLER.search(p):
            return False
    # an apology for the form of an answer declines nothing: the refusal needs no more than its own sentence
    return said and not re.search(r"[:：]\s*\S{3,}.{30,}", o)


def copies(o: str, question: str, instruction: str | None, slack: int = 12) -> bool:
    """Whether `o` only repeats the question, or instruction and question."""
    f, q, i = fold(LEAD.sub("", o)), fold(question), fold(instruction)
    if len(q) < 4 or not f:
        return False
    rest = f.replace(i, "", 1) if i and f.startswith(i) and i != q else f
    left = rest.replace(q, "")
    if q in rest and len(left) <= min(slack, 0.2 * len(q) + 2):
        return True
    if f in (q, i + q, q + i):
        return True
    if 0.85 * len(q) <= len(rest) <= 1.15 * len(q) and rest[:6] == q[:6]:
        return difflib.SequenceMatcher(None, rest, q, autojunk=False).ratio() >= 0.93
    return False


def _is_list(o: str) -> bool:
    """A list of terms: separated items without a sentence's end, or items at the end."""
    s = o.strip()
    if ITEM.match(s.split("\n")[-1]) and len(s.split("\n")) > 1:
        return True
    return bool(_SEP.search(s)) and not re.search(r"[.!?](?:\s|$)|[。！？]", s) and max(map(len, _SEP.split(s))) <= 60


def _tails(o: str):
    """(whether it is a list, its items or the text as one)."""
    s = o.strip()
    if _is_list(s):
        items = [ITEM.sub("", x) for x in _SEP.split(s) if x.strip()]
        return True, items
    return False, [s]


def _hashes(texts: list[str], kinds: list[bool]):
    """(hash of the last characters before each place, by order; whether they fill the order; place of each text's end)."""
    a = codes("".join("\n" + t for t in texts)).astype(np.uint64)
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    end = np.cumsum(n) - 1
    at = np.arange(a.size) - np.repeat(end - n + 1, n)  # place in its own text
    salt = np.repeat(np.array(kinds, np.uint64) * np.uint64(0xD6E8FEB86659FD93), n)
    out = []
    for w in ORDERS:
        h = np.full(a.size, w * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64) + salt
        for i in range(min(w, a.size)):
            h[i:] = (h[i:] ^ a[: a.size - i]) * np.uint64(0xBF58476D1CE4E5B9)
            h[i:] ^= h[i:] >> np.uint64(31)
        out.append((h, at >= w - 1))
    return out, end


def last_contexts(outputs: list) -> tuple[list, list]:
    """(whether each text is a list of terms, hashes of its last characters by order, fewer where it is shorter)."""
    kinds, lasts = [], []
    for o in outputs:
        lst, items = _tails(o)
        kinds.append(lst)
        lasts.append((items[-1] if items else o).strip().lower())
    got, end = _hashes(lasts, kinds)
    return kinds, [[int(np.int64(h[e].view(np.int64))) for h, full in got if full[e]] for e in end]


def _let(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64((1 << FILTER) - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _count_contexts(sent):
    """(h, ends, n) of the contexts that the filter lets through, counted by some thousand texts."""

    def run(batches):
        bits = sent.value
        for b in batches:
            units, kinds = [], []
            for o in b.column(0).to_pylist():
                if o is not None and o.strip():
                    lst, items = _tails(o)
                    units += [s.strip().lower() for s in items]
                    kinds += [lst] * len(items)
            hs, ends = [], []
            for lo, hi in groups_by_size(units):
                got, end = _hashes(units[lo:hi], kinds[lo:hi])
                last = np.zeros(got[0][0].size, bool)
                last[end] = True
                for h, full in got:
                    ok = full & _let(bits, h)
                    hs.append(h[ok])
                    ends.append(last[ok])
            h, first, n = np.unique(np.concatenate(hs) if hs else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
            e = np.bincount(first, weights=np.concatenate(ends) if ends else None, minlength=h.size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e), pa.array(n.astype(np.int64))], names=["h", "ends", "n"])

    return run


def end_chances(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """`judged` (with lst: a list of terms?, hs: hashes of its last characters, r: hash of its text) with chance: how likely
    a text of column o of `responses` ends after these characters, itself and its copies left out.

    Equal ends are one chain before they meet the counts.
    """
    spark = judged.sparkSession
    bit = F.col("h").bitwiseAND(F.lit((1 << FILTER) - 1))
    asked = judged.select(F.explode("hs").alias("h"))
    words = asked.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    counts = responses.select("o").mapInArrow(_count_contexts(spark.sparkContext.broadcast(bits)), "h long, ends long, n long")
    counts = counts.groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    again = judged.groupBy("r").agg(F.least(F.count("*"), F.lit(COPIES)).alias("c"))
    d = judged.join(again, "r").withColumn("chain", F.xxhash64("hs", "c"))
    chains = d.groupBy("chain").agg(F.first("hs").alias("hs"), F.first("c").alias("c"))
    met = chains.select("chain", "c", F.posexplode("hs").alias("place", "h")).join(counts, "h")
    steps = F.array_sort(F.collect_list(F.struct("place", (F.col("ends") - F.col("c")).alias("e"), (F.col("n") - F.col("c")).alias("n"))))
    met = met.groupBy("chain").agg(steps.alias("steps"))
    drawn = lambda p, x: (F.greatest(x["e"], F.lit(0)) + DRAWN * p) / (F.greatest(x["n"], F.lit(0)) + DRAWN)
    met = met.select("chain", F.aggregate("steps", F.lit(UNSEEN), drawn).alias("chance"))
    return d.join(met, "chain", "left").drop("chain", "c")


def _proper(o: str, question: str) -> str:
    """The answer without a repeated question or an apology before it."""
    s = LEAD.sub("", o.strip())
    q = question.strip()
    if q and s[: len(q)].lower() == q.lower():
        s = s[len(q) :]
    first = _SENT.match(s)
    if first and FILLER.search(first.group()) and len(first.group()) < 80 and fold(s[first.end() :]):
        s = s[first.end() :]
    head = re.match(r"[^:：.!?。！？]{2,40}[:：]\s*", s)
    if head and fold(s[head.end() :]):
        s = s[head.end() :]
    return s


def broken_pairs(
    rows: DataFrame, model: Model, key: str = "row_id", instruction: str = "instruction", question: str = "input", answer: str = "output"
) -> DataFrame:
    """(key, defect) for each row whose answer is empty, truncated, refusal, copy or other_language.

    A row has the first defect of empty, refusal, copy, truncated, other_language that it shows. Where the
    question is null or blank the instruction is the question. Null keys give no rows; repeated rows give one.
    """
    kd = rows.schema[key].dataType.simpleString()
    d = rows.select(F.col(key).alias("k"), F.col(instruction).alias("i"), F.col(question).alias("q"), F.col(answer).alias("o")).where("k is not null")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(c):
        n = len(c["k"])
        told, broken, foreign, spared, ask = [None] * n, [False] * n, [False] * n, [False] * n, []
        for m, (i, q, o) in enumerate(zip(c["i"], c["q"], c["o"])):
            q = q if q and q.strip() else i or ""
            if is_empty(o):
                told[m] = "empty"
            elif prescribed(i, o):
                told[m] = "none"
            elif refuses(o):
                told[m] = "refusal"
            elif copies(o, q, i if q != i else None):
                told[m] = "copy"
            else:
                s = o.rstrip()
                broken[m], spared[m] = bool(MARKER.search(s) or ESCAPE.search(s) or OPENED.search(s)), bool(BRACKETS.search(s))
                if not ASKED.search(i or ""):
                    ask.append((m, q, _proper(o, q)))
        for lo, hi in groups_by_size([x + y for _, x, y in ask]):
            part = ask[lo:hi]
            lq, said = Labelled([x for _, x, _ in part], sent.value), Labelled([y for _, _, y in part], sent.value)
            for at, (m, x, y) in enumerate(part):
                foreign[m] = _differs(lq, said, at, x, y)
        lst, hs = last_contexts([o if o is not None and o.strip() else "" for o in c["o"]])
        open_ = [t is None for t in told]
        return {
            "k": c["k"], "told": told, "broken": broken, "foreign": foreign, "spared": spared, "lst": lst,
            "hs": [h if yes else [] for h, yes in zip(hs, open_)], "r": [_name(o) for o in c["o"]],
        }

    schema = f"k {kd}, told string, broken boolean, foreign boolean, spared boolean, lst boolean, hs array<long>, r long"
    judged = end_chances(materialize(arrow_map(d, run, schema), "judged"), d)
    cut = F.col("broken") | (F.col("chance") < RARE_END) & ~F.col("spared")
    defect = F.when(F.col("told") != "none", F.col("told")).when(F.col("told").isNull() & cut, "truncated").when(F.col("told").isNull() & F.col("foreign"), "other_language")
    return judged.select(F.col("k").alias(key), defect.alias("defect")).where("defect is not null").distinct()


def _name(o: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((o or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _differs(q: Labelled, o: Labelled, m: int, a: str, b: str) -> bool:
    """Whether the answer's languages leave out all languages of the question, surely enough."""
    if not q.present[m].any() or not o.present[m].any() or len(fold(b)) < 4:
        return False
    return not (q.present[m] & o.present[m]).any() and q.share[m][o.present[m]].max() < 0.3 and o.share[m][q.present[m]].max() < 0.3
