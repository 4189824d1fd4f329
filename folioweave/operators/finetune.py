"""Fine-tuning data: converters to one message form, rendering, budgets, masks, packing, padding, mixing.

The common form is (system, prompt: array<struct<role,content>>, response: same). Tokens come from a seam: any
column function of text to array<int>; `byte_tokens` is the default without a vocabulary.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MSG = "array<struct<role:string,content:string>>"
#: Labels that count for nothing; a fixed value.
IGNORE = -100
CONVERTERS: dict = {}


def converter(name: str):
    """Register a function DataFrame -> DataFrame of the common form under `name`."""

    def add(fn):
        CONVERTERS[name] = fn
        return fn

    return add


def _msg(role, content) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"))


@converter("alpaca")
def from_alpaca(rows: DataFrame) -> DataFrame:
    """instruction, input, output, system (and history: array of pairs) to the common form; blank parts are skipped."""
    parts = F.filter(F.array("instruction", "input"), lambda x: x.isNotNull() & (F.length(F.trim(x)) > 0))
    prompt = F.array(_msg("user", F.array_join(parts, "\n")))
    if "history" in rows.columns:
        old = F.flatten(F.transform(F.coalesce("history", F.array().cast("array<array<string>>")), lambda h: F.array(_msg("user", h[0]), _msg("assistant", h[1]))))
        prompt = F.concat(old, prompt)
    response = F.when(F.col("output").isNotNull(), F.array(_msg("assistant", F.col("output")))).otherwise(F.expr(f"cast(array() as {MSG})"))
    return rows.select("*", F.coalesce("system", F.lit("")).alias("_system"), prompt.alias("_prompt"), response.alias("_response"))


@converter("sharegpt")
def from_sharegpt(rows: DataFrame, turns: str = "conversations", users=("human", "user"), bots=("gpt", "assistant"), observers=("observation",), callers=("function_call",)) -> DataFrame:
    """conversations (array of from, value) to the common form. A leading system turn is taken off; turns must
    alternate and end with the assistant, else prompt and response are empty."""
    t = F.col(turns)
    lead = F.coalesce(F.get(t, F.lit(0))["from"] == "system", F.lit(False))
    body = F.when(lead, F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)
    ask, say = [*users, *observers], [*bots, *callers]
    role = lambda x: F.when(x["from"].isin(*users), "user").when(x["from"].isin(*bots), "assistant").when(x["from"].isin(*observers), "observation").otherwise("function")
    msgs = F.transform(body, lambda x: _msg(role(x), x["value"]))
    good = F.forall(F.transform(body, lambda x, i: F.when(i % 2 == 0, x["from"].isin(*ask)).otherwise(x["from"].isin(*say))), lambda b: b) & (F.size(body) % 2 == 0) & (F.size(body) > 0)
    empty = F.expr(f"cast(array() as {MSG})")
    system = F.when(lead, F.get(t, F.lit(0))["value"]).otherwise(F.coalesce("system", F.lit("")) if "system" in rows.columns else F.lit(""))
    return rows.select("*", system.alias("_system"), F.when(good, F.slice(msgs, F.lit(1), F.size(msgs) - 1)).otherwise(empty).alias("_prompt"), F.when(good, F.slice(msgs, F.size(msgs), F.lit(1))).otherwise(empty).alias("_response"))


@converter("openai")
def from_openai(rows: DataFrame, turns: str = "messages") -> DataFrame:
    """messages (role, content) to the common form; neighbouring tool answers become one observation, and
    trailing ones are dropped."""
    body = F.filter(turns, lambda x: x["role"] != "system")
    tool = F.transform(body, lambda x: _msg(F.when(x["role"] == "tool", "observation").otherwise(x["role"]), x["content"]))

    def fold(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_msg("observation", F.concat_ws("\n", last["content"], x["content"]))))
        return F.when((F.size(acc) > 0) & (last["role"] == "observation") & (x["role"] == "observation"), joined).otherwise(F.concat(acc, F.array(x)))

    msgs = F.aggregate(tool, F.expr(f"cast(array() as {MSG})"), fold)
    msgs = F.when(F.element_at(msgs, -1)["role"] == "observation", F.slice(msgs, F.lit(1), F.size(msgs) - 1)).otherwise(msgs)
    system = F.coalesce(F.get(F.filter(turns, lambda x: x["role"] == "system"), F.lit(0))["content"], F.lit(""))
    n = F.size(msgs)
    ok = (n >= 2) & (F.element_at(msgs, -1)["role"] == "assistant")
    empty = F.expr(f"cast(array() as {MSG})")
    return rows.select("*", system.alias("_system"), F.when(ok, F.slice(msgs, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(empty).alias("_prompt"), F.when(ok, F.slice(msgs, n, F.lit(1))).otherwise(empty).alias("_response"))


@converter("pair")
def from_pair(rows: DataFrame) -> DataFrame:
    """chosen and rejected message arrays: the shared prompt, and both last messages as responses."""
    n, m = F.size("chosen"), F.size("rejected")
    empty = F.expr(f"cast(array() as {MSG})")
    ok = (n >= 2) & (m >= 1)
    return rows.select("*", F.lit("").alias("_system"), F.when(ok, F.slice("chosen", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(empty).alias("_prompt"), F.when(ok, F.concat(F.slice("chosen", n, F.lit(1)), F.slice("rejected", m, F.lit(1)))).otherwise(empty).alias("_response"))


def align(rows: DataFrame, form: str) -> DataFrame:
    """Only the common form, by the converter registered under `form`."""
    return CONVERTERS[form](rows).select(F.col("_system").alias("system"), F.col("_prompt").alias("prompt"), F.col("_response").alias("response"))


def usable(stage: str = "sft") -> Column:
    """Whether an aligned row fits a stage: an odd number of prompt turns, and one response (two for pairs)."""
    n = F.size("response")
    return (F.size("prompt") % 2 == 1) & ((n == 1) if stage == "sft" else (n >= 2))


def render_chatml(system, messages) -> Column:
    """The text of a conversation in ChatML; a blank system turn is left out."""
    turn = lambda r, c: F.concat(F.lit("<|im_start|>"), r, F.lit("\n"), c, F.lit("<|im_end|>\n"))
    head = F.when(F.length(F.trim(system)) > 0, turn(F.lit("system"), system)).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.transform(messages, lambda m: turn(m["role"], m["content"])), ""))


def drop_thoughts(messages: Column) -> Column:
    """Messages without the <think> spans of the assistant's earlier turns."""
    return F.transform(messages, lambda m: _msg(m["role"], F.when(m["role"] == "assistant", F.regexp_replace(m["content"], r"(?s)<think>.*?</think>\s*", "")).otherwise(m["content"])))


def byte_tokens(t) -> Column:
    """Default tokens: the bytes of UTF-8."""
    h = F.hex(F.encode(t, "UTF-8"))
    return F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def budget(source_len, target_len, cutoff) -> Column:
    """struct(source, target): lengths that share `cutoff` in proportion, the shorter side kept where it may be."""
    s, t, c = source_len.cast("long"), target_len.cast("long"), F.lit(cutoff)
    most = F.when(t * 2 < c, c).when(s * 2 < c, c - s).otherwise(F.floor(c * (t / (s + t))))
    new_t = F.least(most, t)
    return F.struct(F.least(F.greatest(c - new_t, F.lit(0)), s).alias("source"), new_t.alias("target"))


def supervised(rows: DataFrame, prompt: str, response: str, cutoff: int, tokens=byte_tokens, train_on_prompt: bool = False, eos: int = 256) -> DataFrame:
    """`rows` with input_ids, attention_mask and labels: prompt masked, both cut to the budget, eos at the end."""
    d = rows.withColumn("_p", tokens(F.col(prompt))).withColumn("_r", F.concat(tokens(F.col(response)), F.array(F.lit(eos))))
    d = d.withColumn("_b", budget(F.size("_p"), F.size("_r"), cutoff))
    p, r = F.slice("_p", F.lit(1), F.col("_b.source").cast("int")), F.slice("_r", F.lit(1), F.col("_b.target").cast("int"))
    lab = p if train_on_prompt else F.array_repeat(F.lit(IGNORE), F.size(p))
    ids = F.concat(p, r)
    return d.select(*rows.columns, ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), F.concat(lab, r).alias("labels"))


def fill_packs(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places of `lengths` by pack: each pack takes the longest sequence that still fits, again and again.

    Sequences wait in one list a length. `longest[r]` is the greatest length of at most r that still has any; it is
    found by following links to shorter lengths, which are shortened on the way. Lengths over the capacity, and those
    under 1, are left out; of equal lengths the last one goes first.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for place, n in enumerate(lengths):
        if 0 < n <= capacity:
            waiting[n].append(place)
    link = list(range(capacity + 1))

    def longest(room: int) -> int:
        seen = []
        while room and not waiting[room]:
            seen.append(room)
            room = link[room] if link[room] != room else room - 1
        for r in seen:
            link[r] = room
        return room

    packs = []
    while longest(capacity):
        pack, room = [], capacity
        while (n := longest(room)) > 0:
            pack.append(waiting[n].pop())
            room -= n
        packs.append(pack)
    return packs


def pack_greedy(rows: DataFrame, batch: str, key: str, length: str, cutoff: int) -> DataFrame:
    """(batch, key, pack, place): sequences of a batch to packs of at most `cutoff`, longest fitting first.

    A batch is one group and must be bounded by its maker (a thousand rows, say); sequences over `cutoff` are left out.
    """
    kb, kk = rows.schema[batch].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        packs = fill_packs([int(n) for n in pdf["n"]], cutoff)
        out = [(pdf["b"].iloc[0], pdf["k"].iloc[i], p, place) for p, pack in enumerate(packs) for place, i in enumerate(pack)]
        return pd.DataFrame(out, columns=["batch", "key", "pack", "place"])

    d = rows.select(F.col(batch).alias("b"), F.col(key).alias("k"), F.col(length).alias("n"))
    return d.groupBy("b").applyInPandas(one, f"batch {kb}, key {kk}, pack int, place int")


def packed_sequences(rows: DataFrame, packs: DataFrame, key: str, cutoff: int, pad: int = 0) -> DataFrame:
    """One row a pack: ids, labels and segment numbers concatenated and padded to cutoff+1, and the boundaries."""
    d = packs.join(rows.select(F.col(key).alias("key"), "input_ids", "labels"), "key")
    g = d.groupBy("batch", "pack").agg(F.sort_array(F.collect_list(F.struct("place", "input_ids", "labels"))).alias("l"))
    ids, lab = F.flatten(F.transform("l", lambda x: x["input_ids"])), F.flatten(F.transform("l", lambda x: x["labels"]))
    seg = F.flatten(F.transform("l", lambda x, i: F.array_repeat(i + 1, F.size(x["input_ids"]))))
    lens = F.transform("l", lambda x: F.size(x["input_ids"]))
    bounds = F.aggregate(lens, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    gap = F.greatest(F.lit(cutoff + 1) - F.size(ids), F.lit(0))
    return g.select("batch", "pack", F.concat(ids, F.array_repeat(F.lit(pad), gap)).alias("input_ids"), F.concat(lab, F.array_repeat(F.lit(IGNORE), gap)).alias("labels"), F.concat(seg, F.array_repeat(F.lit(0), gap)).alias("attention_mask"), bounds.alias("boundaries"), gap.alias("padding"))


def blocks(rows: DataFrame, batch: str, order: str, tokens: str, size: int) -> DataFrame:
    """(batch, block, ids): the tokens of a batch end to end in blocks of `size`; the tail goes. Batches are bounded by their maker."""
    flat = rows.groupBy(batch).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens])).alias("all"))
    n = F.floor(F.size("all") / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return flat.select(batch, F.posexplode(F.transform(starts, lambda i: F.slice("all", i * size + 1, F.lit(size)))).alias("block", "ids"))


def block_mask(segments) -> Column:
    """Boolean matrix of a packed sequence: a token sees earlier ones of its own segment, padding (0) sees nothing."""
    n = F.size(segments)
    idx = F.sequence(F.lit(0), n - 1)
    return F.transform(idx, lambda i: F.transform(idx, lambda j: (j <= i) & (F.get(segments, i) == F.get(segments, j)) & (F.get(segments, i) != 0)))


def pad(ids, to, value: int) -> Column:
    """An array cut or padded to a length."""
    cut = F.slice(ids, F.lit(1), to)
    return F.concat(cut, F.array_repeat(F.lit(value), F.greatest(to - F.size(cut), F.lit(0))))


def padded_batches(rows: DataFrame, batch: str, cutoff: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Rows padded to the longest of their batch, `cutoff` at most: ids and mask with 0, labels with the ignored one."""
    longest = F.least(F.max(F.size(ids)).over(Window.partitionBy(batch)), F.lit(cutoff))
    d = rows.withColumn("_n", longest)
    n = F.least(F.size(ids), F.col("_n"))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_n") - n))
    return d.withColumn("attention_mask", mask).withColumn(labels, pad(F.col(labels), F.col("_n"), IGNORE)).withColumn(ids, pad(F.col(ids), F.col("_n"), 0)).drop("_n")


def resample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows of the dataset: all in hash order, and again from the start where it is short (copy from 0)."""
    have = rows.count()
    if not have:
        return rows.withColumn("copy", F.lit(0)).limit(0)
    from .datasets import split_exact

    full, rest = divmod(n, have)
    part = split_exact(rows, key, rest / have, seed, least=0).where("split = 'train'").drop("split").withColumn("copy", F.lit(full)) if rest else None
    whole = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(full - 1)))) if full else None
    return part if whole is None else whole if part is None else whole.unionByName(part)


def interleave(sets: list[DataFrame], weights: list[float], key: str, seed: int = 0, stop: str = "first") -> DataFrame:
    """Datasets in turn at their rates: place = rank/weight. stop: 'first' ends when one set runs out, 'all' when all have.

    Ranks in hash order are made over ranges of rows, so no task counts a whole set.
    """
    from ..functions.text import hash_order
    from .fusion import numbered

    both, ends = None, []
    for i, (d, w) in enumerate(zip(sets, weights)):
        h = d.withColumn("part", F.lit(i)).withColumn("_h", hash_order(key, seed=seed))
        p = numbered(h, ["_h", key], "_r").withColumn("place", (F.col("_r") + 1) / w).drop("_h", "_r")
        ends.append(p.agg(F.max("place")).first()[0] or 0.0)
        both = p if both is None else both.unionByName(p)
    return both.where(F.col("place") <= min(ends)) if stop == "first" else both


def mismatched(rows: DataFrame, batch: str, order: str, response: str) -> DataFrame:
    """`rows` with other: the response of the row before in the batch, the first getting the last one."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(response).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("other", F.coalesce(F.lag(response).over(w), last))


def unsupervised(rows: DataFrame, prompt: str, response: str, cutoff: int, tokens=byte_tokens, eos: int = 256) -> DataFrame:
    """`rows` with input_ids (the prompt) and labels (the answer that would follow), both cut to the budget: for generation."""
    d = rows.withColumn("_p", tokens(F.col(prompt))).withColumn("_r", F.concat(tokens(F.col(response)), F.array(F.lit(eos))))
    d = d.withColumn("_b", budget(F.size("_p"), F.size("_r"), cutoff))
    ids, lab = F.slice("_p", F.lit(1), F.col("_b.source").cast("int")), F.slice("_r", F.lit(1), F.col("_b.target").cast("int"))
    return d.select(*rows.columns, ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), lab.alias("labels"))


def preference(rows: DataFrame, prompt: str, chosen: str, rejected: str, cutoff: int, tokens=byte_tokens, eos: int = 256) -> DataFrame:
    """`rows` with chosen and rejected input_ids and labels: one prompt, cut with the longer answer, masked in both."""
    d = rows.withColumn("_p", tokens(F.col(prompt)))
    for c, n in ((chosen, "_c"), (rejected, "_j")):
        d = d.withColumn(n, F.concat(tokens(F.col(c)), F.array(F.lit(eos))))
    d = d.withColumn("_b", budget(F.size("_p"), F.greatest(F.size("_c"), F.size("_j")), cutoff))
    p = F.slice("_p", F.lit(1), F.col("_b.source").cast("int"))
    out = []
    for n, name in (("_c", "chosen"), ("_j", "rejected")):
        r = F.slice(n, F.lit(1), F.col("_b.target").cast("int"))
        out += [F.concat(p, r).alias(f"{name}_input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), F.size(p)), r).alias(f"{name}_labels")]
    return d.select(*rows.columns, *out)


def feedback(rows: DataFrame, prompt: str, response: str, good: str, other: str, cutoff: int, tokens=byte_tokens, eos: int = 256) -> DataFrame:
    """`rows` encoded with their response, the same with a mismatched one (kl_ columns), and whether the response was wanted."""
    own = supervised(rows, prompt, response, cutoff, tokens, eos=eos)
    kl = supervised(own.withColumnsRenamed({c: f"_{c}" for c in ("input_ids", "attention_mask", "labels")}), prompt, other, cutoff, tokens, eos=eos)
    kl = kl.withColumnsRenamed({c: f"kl_{c}" for c in ("input_ids", "attention_mask", "labels")}).withColumnsRenamed({f"_{c}": c for c in ("input_ids", "attention_mask", "labels")})
    return kl.withColumn("kto_tags", F.coalesce(F.col(good), F.lit(False)))


def truncated_turns(messages, tokens_of, cutoff: int) -> Column:
    """The leading messages whose tokens together are at most `cutoff`; tokens_of: a message to its number of tokens."""
    sizes = F.transform(messages, tokens_of)
    upto = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    return F.slice(messages, F.lit(1), F.size(F.filter(upto, lambda n: n <= cutoff)))


def few_shot_prompt(examples, question, subject, letters: tuple = ("A", "B", "C", "D")) -> Column:
    """Examples (array of struct question, choices, answer) and a question without its answer as turns: a system line on
    the subject, then questions and answers."""
    ask = lambda e: F.concat(e["question"], F.array_join(F.transform(e["choices"], lambda c, i: F.concat(F.lit("\n"), F.element_at(F.array(*[F.lit(x) for x in letters]), i + 1), F.lit(". "), c)), ""), F.lit("\nAnswer:"))
    shots = F.flatten(F.transform(examples, lambda e: F.array(_msg("user", ask(e)), _msg("assistant", e["answer"]))))
    system = _msg("system", F.concat(F.lit("The following are multiple choice questions (with answers) about "), subject, F.lit(".\n\n")))
    return F.concat(F.array(system), shots, F.array(_msg("user", ask(question))))


def tool_call(text) -> Column:
    """struct(name, arguments) of an answer in the form 'Action: name / Action Input: {json}'; null if it has none."""
    name = F.trim(F.regexp_extract(text, r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", 1))
    args = F.trim(F.regexp_extract(text, r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", 2))
    return F.when((name != "") & F.get_json_object(args, "$").isNotNull(), F.struct(name.alias("name"), args.alias("arguments")))


def tool_text(name, arguments) -> Column:
    """The same, as text."""
    return F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "), arguments)


def valid_tokens(labels) -> Column:
    """Number of labels that count."""
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def rows_at(rows: DataFrame, order: list, first: int, last: int, step: int = 1) -> DataFrame:
    """Rows at the places first, first+step, ... before `last` in `order`, with their place; no task numbers them alone."""
    from .fusion import numbered

    n = numbered(rows, order, "place")
    return n.where((F.col("place") >= first) & (F.col("place") < last) & ((F.col("place") - first) % step == 0))


def render_plain(system, messages, user: str = "Human: ", bot: str = "Assistant:") -> Column:
    """A conversation as plain lines, with a system line before it where there is one."""
    turn = lambda m: F.when(m["role"] == "assistant", F.concat(F.lit(bot), m["content"], F.lit("\n"))).otherwise(F.concat(F.lit(user), m["content"], F.lit("\n")))
    return F.concat(F.when(F.length(F.trim(system)) > 0, F.concat(system, F.lit("\n\n"))).otherwise(F.lit("")), F.array_join(F.transform(messages, turn), ""))


def joined_vectors(a: DataFrame, b: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """(key, vector): vectors of two teachers end to end, of the keys that both have."""
    return a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key).select(key, F.concat("_a", "_b").alias(vector))
