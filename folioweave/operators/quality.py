"""Routing of passages by quality: rules in order as one table of conditions, its counters, and what is asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# --- fixed values: labels from worst to best, names of routes and reasons, limits --------------------------------
LABELS = ("drop", "extra", "core")
CORE_WORDS, CORE_SENTENCES, EXTRA_WORDS, EXTRA_SENTENCES, MOST_NOISE = 50, 2, 8, 2, 0.08
SHORT_CORE_WORDS, LONG_DROP_WORDS = 35, 18
FALLBACK = "llm_error_fallback_extra"
# ------------------------------------------------------------------------------------------------------------------


def passage_flags(text, has_figure: Column) -> dict[str, Column]:
    """What the rules rest on, by name. `text` names or is a column of texts; that named tx.SINGLE is collapsed already."""
    named = isinstance(text, str)
    t = F.col(text) if named and text == tx.SINGLE else F.coalesce(F.col(text) if named else text, F.lit(""))
    return {
        "words": tx.chunk_count(t), "sentences": F.size(tx.simple_sentences(t)), "noise": tx.noise_share(tx.collapse(t)), "high_value": tx.high_value(t),
        "caption": tx.is_caption(t), "exercise": tx.is_exercise(t), "steps": tx.is_steps(t), "needs_figure": tx.needs_figure(t, has_figure),
        "starts_incomplete": tx.starts_incomplete(t), "ends_incomplete": tx.ends_incomplete(t), "knowledge": tx.core_knowledge(t),
        "low_information": tx.low_information(t), "empty": tx.collapse(t) == "",
    }


def quality_route(text, has_figure: Column) -> Column:
    """struct(route, reason) of a passage by the first rule that holds; need_llm where none decides. Null is empty."""
    f = passage_flags(text, has_figure)
    whole = ~f["steps"] & ~f["starts_incomplete"]
    rules = (
        ("drop", "empty", f["empty"]),
        ("drop", "too_noisy", f["noise"] > MOST_NOISE),
        ("drop", "low_information", f["low_information"]),
        ("drop", "incomplete_both_ends", f["starts_incomplete"] & f["ends_incomplete"]),
        ("drop", "exercise_or_question_block", f["exercise"]),
        ("drop", "caption_or_strong_figure_dependency", f["needs_figure"]),
        ("core_rule", "rule_high_quality", whole & f["knowledge"] & (f["words"] >= CORE_WORDS) & (f["sentences"] >= CORE_SENTENCES)),
        ("extra_rule", "rule_short_but_complete", whole & f["high_value"] & (f["words"] >= EXTRA_WORDS) & (f["words"] < CORE_WORDS) & (f["sentences"] <= EXTRA_SENTENCES)),
        ("need_llm", "borderline_high_value", f["high_value"] & (f["words"] >= EXTRA_WORDS)),
        ("need_llm", "borderline", F.lit(True)),
    )
    out = F
    for route, reason, holds in rules:
        out = out.when(holds, F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason")))
    return out


def with_quality(docs: DataFrame, text: str, has_figure: Column | None = None) -> DataFrame:
    """`docs` with route, reason and the flags they rest on."""
    fig = has_figure if has_figure is not None else F.lit(False)
    d = docs.withColumn(tx.SINGLE, tx.collapse(F.coalesce(text, F.lit(""))))
    f = passage_flags(tx.SINGLE, fig)
    return d.withColumn("q", quality_route(tx.SINGLE, fig)).select(
        *docs.columns, "q.route", "q.reason", *[f[c].alias(c) for c in ("starts_incomplete", "ends_incomplete", "high_value", "steps")], F.round(f["noise"], 6).alias("noise"),
    )


def asks_again(text, label, route_reason, reason, has_figure: Column) -> Column:
    """Whether a judged label should be judged once more: a label that its own passage speaks against."""
    f = passage_flags(text, has_figure)
    spoilt = f["exercise"] | f["needs_figure"]
    thin = (label == "core") & ((f["words"] < SHORT_CORE_WORDS) | (f["sentences"] <= 1))
    lost = (label == "drop") & f["high_value"] & (f["words"] >= LONG_DROP_WORDS)
    vague = (label == "core") & (route_reason == "borderline_high_value") & ~f["knowledge"]
    return F.coalesce(F.when(spoilt, label != "drop").otherwise(thin | lost | vague), F.lit(False))


def judged_label(label, reason) -> Column:
    """struct(label, reason) of a model's answer; an unknown or missing label is extra with the reason of a fallback."""
    known = F.coalesce(label.isin(*LABELS), F.lit(False))
    wrong = F.concat(F.lit(f"{FALLBACK}:invalid_label:"), F.coalesce(label, F.lit("None")))
    return F.struct(F.when(known, label).otherwise("extra").alias("label"), F.when(known, F.coalesce(reason, F.lit("unknown"))).otherwise(wrong).alias("reason"))


#: How a passage and its flags are shown to a judge.
SHOWN_TEXT, SHOWN_FLAGS, YES, NO = "正文：", "辅助信息：", "是", "否"
SHOWN = (("是否涉及图表引用", "figures"), ("是否有关联脚注", "notes"), ("是否像图题/表题", "caption"), ("是否像练习题/题目", "exercise"), ("是否像编号步骤/选项", "steps"), ("是否强依赖图表", "needs_figure"))
SHOWN_PAGE, SHOWN_LEVEL = "原始页码", "文档层级"


def judge_text(text, has_figure: Column, has_note: Column, page=None, level=None) -> Column:
    """What a judge is shown of a passage: its text, and a line for each flag; page and level where they are known."""
    flags = {**passage_flags(text, has_figure), "figures": has_figure, "notes": has_note}
    lines = [F.lit(SHOWN_TEXT), tx.collapse(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(""), F.lit(SHOWN_FLAGS)]
    lines += [F.concat(F.lit(f"- {name}: "), F.when(flags[c], YES).otherwise(NO)) for name, c in SHOWN]
    for name, c in ((SHOWN_PAGE, page), (SHOWN_LEVEL, level)):
        if c is not None:
            lines.append(F.when(c.isNotNull(), F.concat(F.lit(f"- {name}: "), c.cast("string"))))
    return F.trim(F.array_join(F.array(*lines), "\n"))


def judge_batches(docs: DataFrame, key: str, shown: str, size: int) -> DataFrame:
    """(batch, n, text): documents in batches of `size` by key, each in a tag with its key."""
    from . import datasets

    b = datasets.batches(docs.select(F.col(key).alias("k"), F.col(shown).alias("t")), size, ["k"], drop_last=False)
    one = F.concat(F.lit('<doc unique_id="'), F.col("k").cast("string"), F.lit('">\n'), F.col("t"), F.lit("\n</doc>"))
    g = b.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("k", one.alias("x")))).alias("l"))
    return g.select("batch", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["x"]), "\n\n").alias("text"))


def stricter(a, b) -> Column:
    """The worse of two labels; an unknown label counts as drop."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(LABELS) for x in (n, i)])
    low = F.least(F.coalesce(F.try_element_at(rank, a), F.lit(0)), F.coalesce(F.try_element_at(rank, b), F.lit(0)))
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), low + 1)


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route", "reason").agg(F.count("*").alias("n"))


def unfit_documents(docs: DataFrame, text: str, marks: tuple = (), most: int = 128_000) -> DataFrame:
    """Documents with content, without any of the marks of failed extraction, cut to `most` characters as a model takes them."""
    t = F.coalesce(F.col(text), F.lit(""))
    bad = F.lit(False)
    for m in marks:
        bad = bad | F.contains(t, F.lit(m))
    return docs.where((F.trim(t) != "") & ~bad).withColumn(text, F.substring(t, 1, most))
