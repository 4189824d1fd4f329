"""Units that go on over page breaks: joined to a fixpoint, in runs of pages that cannot reach into each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import materialize
from . import fusion

# --- fixed values: pages looked ahead, rounds, the types that go on in each other, and types that may be skipped -----
AHEAD, ROUNDS = 3, 6
GOES_ON = {("body", "body"), ("caption", "caption"), ("caption", "body")}
BRIDGE = {"caption", "footnote", "heading", ""}
# ----------------------------------------------------------------------------------------------------------------------


def _with_marks(units: DataFrame) -> DataFrame:
    """Units with what the rules ask of their beginnings and ends; joining texts changes neither of the others."""
    t = tx.keep_paragraphs("text")
    return units.withColumn("text", t).select(
        "*", tx.ends_unfinished("text").alias("open"), tx.starts_as_continuation("text").alias("goes"), tx.starts_section("text").alias("section"),
        tx.starts_caption("text").alias("titled"), F.coalesce(tx.caption_name("text"), F.lit("")).alias("name"), (F.length("text") > 0).alias("full"),
    )


def page_runs(units: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """(source, page_no, run): pages with equal runs may share units, those of different runs never do.

    A page that begins with a heading and has a body lets nothing past or into it, so a run starts there. Nor does a page
    that ends in a finished body and has more finished units than the pages before it can take (one each, beyond the
    unfinished ones), so a run ends there. Runs are numbered by carried sums over ranges of pages.
    """
    free = F.col("unit_type") != "footnote"
    key = F.struct("unit_no")
    done = free & ~F.col("open") & F.col("full") & F.col("unit_type").isin("body", "caption")
    p = units.groupBy(*page).agg(
        F.min_by("unit_type", F.when(free, key)).alias("first"), F.max_by(F.when(done, F.col("unit_type")), F.when(free, key)).alias("last"),
        F.max((F.col("unit_type") == "body").cast("int")).alias("body"), F.count_if(done).alias("done"),
    )
    p = p.withColumn("starts", (F.col("first") == "heading") & (F.col("body") == 1)).withColumn("ends", (F.col("last") == "body") & (F.col("done") > AHEAD + 1))
    return fusion.carried(p, list(page), lambda prev: F.coalesce("starts", F.lit(False)) | F.coalesce(prev("ends"), F.lit(False)) | ~F.col(page[0]).eqNullSafe(prev(page[0])), "run", [page[0], "ends"]).select(*page, "run")


def _merge(pages: list[list[dict]], ahead: int, rounds: int) -> list[list[dict]]:
    """Pages of units, each joined with what goes on from it."""

    def fits(a: dict, b: dict) -> bool:
        if (a["type"], b["type"]) not in GOES_ON or not a["open"] or not b["full"] or not a["full"]:
            return False
        if b["goes"]:
            return True
        if a["type"] != "caption" or b["section"]:
            return False
        return not (b["type"] == "caption" and b["titled"] and a["name"] and b["name"] and a["name"] != b["name"])

    def offer(page: list[dict], kind: str) -> dict | None:
        free = [u for u in page if u["type"] != "footnote"][:2]
        types = [u["type"] for u in free]
        if kind == "caption":
            return free[0] if types[:1] in (["caption"], ["body"]) else None
        return free[0] if types[:1] == ["body"] else free[1] if types == ["caption", "body"] else None

    for _ in range(rounds):
        changed = False
        for at in range(len(pages) - 2, -1, -1):
            last = next((u for u in reversed(pages[at]) if u["type"] != "footnote"), None)
            if last is None or last["type"] not in ("body", "caption"):
                continue
            for page in pages[at + 1 : at + 1 + ahead]:
                if not page:
                    continue
                unit = offer(page, last["type"])
                if unit is not None and fits(last, unit):
                    last["parts"] += unit["parts"]
                    last["open"] = unit["open"]
                    page.remove(unit)
                    changed = True
                    break
                if last["type"] == "caption" or any(u["type"] not in BRIDGE for u in page):
                    break
        pages = [p for p in pages if p]
        if not changed:
            break
    return pages


def merge_across_pages(units: DataFrame, ahead: int = AHEAD, rounds: int = ROUNDS) -> DataFrame:
    """Units (source, page_no, unit_no, unit_type, text) with those joined that go on over a page break.

    The last unit of a page that is no footnote looks for its continuation on the next pages, `ahead` at most, past
    pages without body text. Only the marks of beginnings and ends, and places, go to Python, in runs of pages; texts
    are joined by the plan. Result: (source, page_no, unit_no, unit_type, text, pages). Rows without a source are one
    source. A run without any of its limits (see `page_runs`) is one group.
    """
    u = materialize(_with_marks(units.select("source", "page_no", "unit_no", "unit_type", "text")), "units")
    runs = page_runs(u)
    marks = u.drop("text").join(runs.withColumnRenamed("source", "_s").withColumnRenamed("page_no", "_p"), F.col("source").eqNullSafe(F.col("_s")) & F.col("page_no").eqNullSafe(F.col("_p"))).drop("_s", "_p")
    kp, ku, ks = (units.schema[c].dataType.simpleString() for c in ("page_no", "unit_no", "source"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_no", "unit_no"], kind="stable", na_position="last")
        pages: dict = {}
        for n, r in enumerate(pdf.itertuples(index=False)):
            pages.setdefault(str(r.page_no), []).append({"type": r.unit_type or "", "open": r.open, "goes": r.goes, "section": r.section, "titled": r.titled, "name": r.name, "full": r.full, "parts": [n]})
        rows = []
        for page in _merge(list(pages.values()), ahead, rounds):
            for k, unit in enumerate(page):
                rows += [(unit["parts"][0], k, place, n) for place, n in enumerate(unit["parts"])]
        head = pdf.iloc[[r[0] for r in rows]].reset_index(drop=True)
        part = pdf.iloc[[r[3] for r in rows]].reset_index(drop=True)
        return pd.DataFrame({
            "source": part["source"], "page_no": part["page_no"], "unit_no": part["unit_no"], "to_page": head["page_no"], "to_type": head["unit_type"],
            "to_no": pd.Series([r[1] for r in rows], dtype="int32"), "place": pd.Series([r[2] for r in rows], dtype="int32"),
        })

    to = marks.groupBy("source", "run").applyInPandas(one, f"source {ks}, page_no {kp}, unit_no {ku}, to_page {kp}, to_type string, to_no int, place int")
    same: Column = F.lit(True)
    for c in ("source", "page_no", "unit_no"):
        same = same & F.col(f"u.{c}").eqNullSafe(F.col(f"t.{c}"))
    d = u.alias("u").join(to.alias("t"), same).select("u.source", "u.page_no", "t.to_page", "t.to_no", "t.to_type", "t.place", "u.text")
    g = d.groupBy("source", "to_page", "to_no", "to_type").agg(F.sort_array(F.collect_list(F.struct("place", "text", "page_no"))).alias("l"))
    text = F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", F.lit(0))["text"], lambda a, x: tx.join_lines(a, x["text"]))
    return g.select("source", F.col("to_page").alias("page_no"), F.col("to_no").alias("unit_no"), F.col("to_type").alias("unit_type"), text.alias("text"), F.array_distinct(F.transform("l", lambda x: x["page_no"])).alias("pages"))


def page_order(pages: DataFrame, by: tuple = ("orig_page_no", "page_no"), within: str = "source", tie: str | None = None) -> DataFrame:
    """`pages` with place: their order by original and own page number, missing ones last, equal ones by `tie`."""
    order = [F.coalesce(c, F.lit(10**9)) for c in by] + ([F.col(tie)] if tie else [])
    return pages.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)) - 1)
