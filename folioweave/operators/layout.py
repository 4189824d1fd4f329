"""Page layout: blocks with geometry, learned running heads, captions, footnotes, regions, reading order.

Blocks are rows (source, page_no, block_no, text, x0, y0, x1, y1, page_height, font); a parser seam delivers
them from binary files, and `blocks_of_lines` makes them from stored page texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def blocks_of_lines(docs: DataFrame, text: str, source: Column, page: Column, line_height: float = 12.0, char_width: float = 6.0, page_height: float | None = None) -> DataFrame:
    """Blocks from the lines of stored texts: one a non-blank line, placed by its number and length; a page is as high as
    its lines where no height is given."""
    d = docs.select(source.alias("source"), page.alias("page_no"), F.split(F.col(text), "\n").alias("ls")).where("ls is not null")
    d = d.select("source", "page_no", F.size("ls").alias("n"), F.posexplode("ls").alias("block_no", "text")).where(F.trim("text") != "")
    y = F.col("block_no") * line_height
    return d.select(
        "source", "page_no", "block_no", "text", F.lit(0.0).alias("x0"), y.alias("y0"), (F.length("text") * char_width).alias("x1"), (y + line_height).alias("y1"),
        (F.lit(page_height) if page_height else F.col("n") * line_height).alias("page_height"), F.when(tx.looks_like_heading("text"), 14.0).otherwise(10.0).alias("font"),
    )


def with_gaps(blocks: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """Gaps above and below each block of its page (0 at the ends), their ratios, and the relative place."""
    w = Window.partitionBy(*page).orderBy("y0", "x0", "block_no")
    h = F.greatest(F.col("page_height"), F.lit(1e-6))
    above = F.greatest(F.lit(0.0), F.coalesce(F.col("y0") - F.lag("y1").over(w), F.lit(0.0)))
    below = F.greatest(F.lit(0.0), F.coalesce(F.lead("y0").over(w) - F.col("y1"), F.lit(0.0)))
    return blocks.select(
        "*", above.alias("gap_above"), below.alias("gap_below"), (above / h).alias("gap_above_ratio"), (below / h).alias("gap_below_ratio"),
        (F.col("y0") / h).alias("top_ratio"), (F.col("y1") / h).alias("bottom_ratio"), ((F.col("y1") - F.col("y0")) / h).alias("height_ratio"),
    )


# --- fixed values: zones and limits of running heads and feet ---------------------------------------------------------
TOP, BOTTOM, FOOT_LENGTH, HEAD_HEIGHT, FOOT_HEIGHT, HEAD_GAP, DEFAULT_WORDS = 0.20, 0.88, 120, 0.03, 0.04, 0.005, 20
HEAD_LENGTH, HEAD_WORDS = 200, 30
#: Least limits of a head, what learned limits are widened by, and the limits of a foot.
LEAST_LENGTH, LEAST_WORDS, WIDER, FOOT_MOST = 160, 24, 1.2, (160, 25, 0.08)
# ----------------------------------------------------------------------------------------------------------------------


def learn_bands(blocks: DataFrame, top: float = TOP, bottom: float = BOTTOM, by: tuple = ()) -> DataFrame:
    """Limits of heads and feet, learned from the blocks of the top and bottom zones; defaults where there are none.

    Heads are learned from blocks that are no page numbers and neither too tall, too long nor of too many words; feet
    from short blocks. Bounded aggregates only: one row (or one a key of `by`).
    """
    n, words = F.length(tx.collapse("text")), tx.chunk_count("text")
    head = (F.col("top_ratio") <= top) & (n > 0) & ~tx.is_page_number("text") & (F.col("height_ratio") <= HEAD_HEIGHT) & (n <= HEAD_LENGTH) & (words <= HEAD_WORDS)
    foot = (F.col("bottom_ratio") >= bottom) & tx.is_short("text", FOOT_LENGTH)
    middle = (F.col("top_ratio") + F.col("bottom_ratio")) / 2
    most = lambda where, x, default: F.coalesce(F.max(F.when(where, x)), F.lit(default))
    return blocks.groupBy(*by).agg(
        most(head, n, FOOT_LENGTH).alias("head_len"), most(head, words, DEFAULT_WORDS).alias("head_words"), most(head, F.col("height_ratio"), HEAD_HEIGHT).alias("head_height"),
        F.coalesce(F.median(F.when(head, F.col("gap_below_ratio"))), F.lit(HEAD_GAP)).alias("head_gap"), F.avg(F.when(head, middle)).alias("head_y"),
        most(foot, n, FOOT_LENGTH).alias("foot_len"), most(foot, words, DEFAULT_WORDS).alias("foot_words"), most(foot, F.col("height_ratio"), FOOT_HEIGHT).alias("foot_height"),
        F.avg(F.when(foot, middle)).alias("foot_y"),
    )


def furniture(blocks: DataFrame, rules: DataFrame, by: tuple = (), marks: tuple = ()) -> DataFrame:
    """`blocks` with furniture: page_number, header, footer or null. `rules` come from learn_bands with the same `by`.

    Page numbers count in both zones only. `marks` are words that show a foot of any size.
    """
    d = blocks.join(rules, list(by), "left") if by else blocks.join(F.broadcast(rules))
    n, words, number = F.length(tx.collapse("text")), tx.chunk_count("text"), tx.is_page_number("text")
    wider = lambda c, least: F.greatest(F.lit(least), F.floor(F.col(c) * WIDER))
    low = F.col("height_ratio") <= F.greatest(F.lit(HEAD_HEIGHT), F.col("head_height") * WIDER)
    head = low & (n <= wider("head_len", LEAST_LENGTH)) & (words <= wider("head_words", LEAST_WORDS))
    foot = (n <= FOOT_MOST[0]) & (words <= FOOT_MOST[1]) & (F.col("height_ratio") <= FOOT_MOST[2])
    for m in marks:
        foot = foot | F.contains(F.lower("text"), F.lit(m))
    at_top, at_bottom = (F.col("top_ratio") <= TOP) & (n > 0), (F.col("bottom_ratio") >= BOTTOM) & (n > 0)
    kind = F.when((at_top | at_bottom) & number, "page_number").when(at_top & head, "header").when(at_bottom & foot, "footer")
    return d.select(*blocks.columns, kind.alias("furniture"))


def body_font(blocks: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """Median font of blocks with more than three characters, by page; 10 where there is none."""
    return blocks.groupBy(*page).agg(F.coalesce(F.median(F.when(F.length("text") > 3, F.col("font"))), F.lit(10.0)).alias("body_font"))


def line_gap(blocks: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """Median of the gaps in (0, 5 % of the page height], by page; 1.2 % of the height where there is none."""
    ok = (F.col("gap_above") > 0) & (F.col("gap_above") <= 0.05 * F.col("page_height"))
    return blocks.groupBy(*page).agg(F.coalesce(F.median(F.when(ok, F.col("gap_above"))), F.max("page_height") * 0.012).alias("line_gap"))


def unit_types(blocks: DataFrame, fonts: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """`blocks` with unit_type: caption, heading, footnote or body."""
    d = blocks.join(fonts, list(page))
    heading = (F.col("font") >= 1.2 * F.col("body_font")) & (tx.chunk_count("text") <= 20)
    note = tx.looks_like_footnote("text") & (F.col("y1") >= NOTE_ZONE * F.col("page_height")) & (F.col("font") <= NOTE_FONT * F.col("body_font"))
    kind = F.when(tx.caption_kind("text").isNotNull(), "caption").when(heading, "heading").when(note, "footnote").otherwise("body")
    return d.withColumn("unit_type", kind)


def overlap_share(a: dict, b: dict) -> Column:
    """Part of box a that box b covers; boxes are dicts of columns x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def outside_regions(blocks: DataFrame, regions: DataFrame, share: float = 0.5, page: tuple = ("source", "page_no")) -> DataFrame:
    """Blocks that no region of their page covers by `share`: an anti join on the page with the boxes as condition."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in (*page, "x0", "y0", "x1", "y1")])
    on = F.lit(True)
    for c in page:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    a = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    b = {c: F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")}
    return blocks.join(r, on & (overlap_share(a, b) >= share), "left_anti")


def merge_units(units: DataFrame, page: tuple = ("source", "page_no"), order: str = "block_no") -> DataFrame:
    """Neighbouring units of one type (body, heading, footnote) of a page as one: text, running font, first place."""
    w = Window.partitionBy(*page).orderBy(order)
    same = (F.col("unit_type") == F.lag("unit_type").over(w)) & F.col("unit_type").isin("body", "heading", "footnote")
    d = units.withColumn("cut", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("unit_no", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = d.groupBy(*page, "unit_no", "unit_type").agg(F.sort_array(F.collect_list(F.struct(order, "text", "font"))).alias("l"))
    fonts = F.transform("l", lambda x: x["font"])
    # each further font is averaged with what came before
    font = F.aggregate(F.slice(fonts, 2, F.greatest(F.size(fonts) - 1, F.lit(0))), F.get(fonts, F.lit(0)), lambda a, x: (a + x) / 2)
    return g.select(*page, "unit_no", "unit_type", F.array_join(F.transform("l", lambda x: F.trim(x["text"])), "\n").alias("text"), font.alias("font"), F.size("l").alias("blocks"))


#: Fixed values of lines: tolerance of one height, widest gap inside a line, how far captions go on.
SAME_ROW, SAME_ROW_SHARE, INLINE_GAP = 2.0, 0.004, 160.0
INDENT, GAP_FACTOR, GAP_SHARE, JUMP, JUMP_SLACK, JUMP_NORMAL, CAPTION_LINES = 40.0, 1.6, 0.03, 1.8, 1.5, 1.8, 8
BOX = ("x0", "y0", "x1", "y1")


def _lines_of(blocks: DataFrame, page: tuple, extra: tuple = ()) -> DataFrame:
    """One row a page with its non-blank lines l in reading order; a page's lines are bounded by the page."""
    line = F.struct("y0", "x0", "x1", "y1", tx.collapse("text").alias("text"), *extra)
    full = F.length(tx.collapse("text")) > 0
    return blocks.where(full).groupBy(*page).agg(F.sort_array(F.collect_list(line)).alias("l"), F.max("page_height").alias("page_height"))


def visual_lines(blocks: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """Lines of a page in reading order, fragments of one visual line joined: (page..., line_no, text, x0, y0, x1, y1, page_height).

    Fragments belong together that stand at one height, the later one right of the earlier at no more than INLINE_GAP.
    """
    d = _lines_of(blocks, page)
    near = F.greatest(F.lit(SAME_ROW), F.col("page_height") * SAME_ROW_SHARE)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = x["x0"] - last["x1"]
        one = (F.abs(last["y0"] - x["y0"]) <= near) & (F.abs(last["y1"] - x["y1"]) <= near) & gap.between(0, INLINE_GAP)
        both = F.struct(
            F.least(last["y0"], x["y0"]).alias("y0"), F.least(last["x0"], x["x0"]).alias("x0"), F.greatest(last["x1"], x["x1"]).alias("x1"), F.greatest(last["y1"], x["y1"]).alias("y1"),
            F.concat_ws(" ", last["text"], x["text"]).alias("text"),
        )
        return F.when((F.size(acc) > 0) & one, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    lines = F.aggregate("l", F.slice("l", 1, 0), step)
    return d.select(*page, "page_height", F.posexplode(lines).alias("line_no", "x")).select(*page, "line_no", *[f"x.{c}" for c in ("text", *BOX)], "page_height")


def caption_regions(lines: DataFrame, gaps: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """(page..., kind, label, text, x0, y0, x1, y1, lines): captions with the lines that go on from them.

    lines: the result of `visual_lines`; gaps: line_gap by page. A caption goes on below itself with about its indent
    and gap, until the gap jumps, another caption begins, or CAPTION_LINES more lines are taken.
    """
    kind, name = tx.caption_kind("text"), tx.caption_name("text")
    d = lines.withColumn("kind", kind).withColumn("name", name).groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("line_no", "text", *BOX, "kind", "name"))).alias("l"), F.max("page_height").alias("h")).join(gaps, list(page), "left")
    normal = F.coalesce("line_gap", F.col("h") * 0.012)
    widest = F.greatest(normal * GAP_FACTOR, F.col("h") * GAP_SHARE)

    def begin(x: Column, open_: bool) -> Column:
        return F.struct(
            x["kind"].alias("kind"), x["name"].alias("name"), x["text"].alias("text"), *[x[c].alias(c) for c in BOX], x["x0"].alias("lx"), x["y1"].alias("ly"),
            F.lit(None).cast("double").alias("gap"), F.lit(1).alias("n"), F.lit(open_).alias("open"),
        )

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = x["y0"] - last["ly"]
        jump = last["gap"].isNotNull() & (gap > F.greatest(last["gap"] * JUMP + JUMP_SLACK, normal * JUMP_NORMAL))
        on = last["open"] & x["kind"].isNull() & (gap >= 0) & (F.abs(x["x0"] - last["lx"]) <= INDENT) & (gap <= widest) & ~jump & (last["n"] <= CAPTION_LINES)
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        grown = F.struct(
            last["kind"].alias("kind"), last["name"].alias("name"), F.concat_ws(" ", last["text"], x["text"]).alias("text"), F.least(last["x0"], x["x0"]).alias("x0"), F.least(last["y0"], x["y0"]).alias("y0"),
            F.greatest(last["x1"], x["x1"]).alias("x1"), F.greatest(last["y1"], x["y1"]).alias("y1"), x["x0"].alias("lx"), x["y1"].alias("ly"), gap.alias("gap"), (last["n"] + 1).alias("n"), F.lit(True).alias("open"),
        )
        shut = F.struct(*[(F.lit(False) if c == "open" else last[c]).alias(c) for c in ("kind", "name", "text", *BOX, "lx", "ly", "gap", "n", "open")])
        rest = F.when(x["kind"].isNotNull(), F.concat(acc, F.array(begin(x, True)))).when(F.size(acc) == 0, acc)
        return rest.when(on, F.concat(head, F.array(grown))).when(last["open"], F.concat(head, F.array(shut))).otherwise(acc)

    first = F.slice(F.transform("l", lambda x: begin(x, True)), 1, 0)
    out = d.select(*page, F.explode(F.aggregate("l", first, step)).alias("c"))
    return out.select(*page, "c.kind", F.col("c.name").alias("label"), "c.text", *[f"c.{b}" for b in BOX], F.col("c.n").alias("lines"))


def block_fonts(lines: DataFrame, block: tuple = ("source", "page_no", "block_no"), size: str = "font") -> DataFrame:
    """(block..., avg_font, max_font, min_font, lines): sizes of a block's lines; lines without one do not count."""
    return lines.groupBy(*block).agg(F.avg(size).alias("avg_font"), F.max(size).alias("max_font"), F.min(size).alias("min_font"), F.count("*").alias("lines"))


#: Fixed values of footnotes: where they may stand, how small they are, how far from the body, how long.
NOTE_ZONE, NOTE_FONT, NOTE_GAP, NOTE_GAP_SHARE, NOTE_LENGTH = 0.78, 0.88, 1.3, 0.010, 8


def split_footnotes(lines: DataFrame, page: tuple = ("source", "page_no"), block: str = "block_no") -> DataFrame:
    """(page..., block_no, body, footnote): the lines of each block before its footnote, and the footnote's text.

    lines: rows (page..., block_no, text, y0, y1, gap_above, font, page_height, body_font, line_gap). A footnote begins at
    the first small line of the page's foot that is set apart and numbered; it goes on over the small lines that follow.
    What stands behind these in the block belongs to neither. Without a footnote, footnote is null.
    """
    d = lines.withColumn("text", tx.collapse("text")).where("text <> ''")
    small = (F.col("y1") >= NOTE_ZONE * F.col("page_height")) & (F.col("font") > 0) & (F.col("font") <= NOTE_FONT * F.col("body_font"))
    apart = F.col("gap_above") >= F.greatest(F.col("line_gap") * NOTE_GAP, F.col("page_height") * NOTE_GAP_SHARE)
    d = d.withColumn("begins", small & apart & tx.looks_like_footnote("text")).withColumn("goes", small & (F.length("text") >= NOTE_LENGTH))
    g = d.groupBy(*page, block).agg(F.sort_array(F.collect_list(F.struct("y0", "text", "begins", "goes"))).alias("l"))
    begin = F.array_position(F.transform("l", lambda x: x["begins"]), F.lit(True)).cast("int")
    g = g.withColumn("at", F.when(begin > 0, begin)).withColumn("rest", F.when(begin > 0, F.slice("l", begin + 1, F.size("l"))))
    stop = F.array_position(F.transform("rest", lambda x: x["goes"]), F.lit(False)).cast("int")
    run = F.when(stop > 0, F.slice("rest", F.lit(1), stop - 1)).otherwise(F.col("rest"))
    text = lambda ls: F.array_join(F.transform(ls, lambda x: x["text"]), " ")
    note = F.when(F.col("at").isNotNull(), text(F.concat(F.slice("l", F.col("at"), F.lit(1)), run)))
    body = F.when(F.col("at").isNotNull(), F.slice("l", F.lit(1), F.col("at") - 1)).otherwise(F.col("l"))
    return g.select(*page, block, text(body).alias("body"), note.alias("footnote"))


def first_page(*values) -> Column:
    """The first of several page numbers that is one: integers, whole numbers, or digits in a text."""
    return F.coalesce(*[F.when(tx.stripped(v.cast("string")).rlike(r"^\d+(?:\.0+)?$"), tx.stripped(v.cast("string")).cast("double").cast("int")) for v in values])


def figure_index(units: DataFrame, text: str = "text", image: str = "image_path", page: str = "page_no") -> DataFrame:
    """(label, caption, short_caption, image_path, page_no) of every figure and table with a caption: the first caption
    of a label by page and text, and the first image that any of its captions has."""
    c = units.select(tx.caption_label(text).alias("label"), tx.collapse(text).alias("caption"), F.nullif(tx.collapse(image), F.lit("")).alias("image"), F.col(page).alias("page_no"))
    c = c.where("label is not null and caption <> ''")
    order = F.struct(F.coalesce("page_no", F.lit(10**9)), "caption")
    g = c.groupBy("label").agg(F.min_by(F.struct("caption", "page_no"), order).alias("f"), F.min_by("image", F.when(F.col("image").isNotNull(), order)).alias("image_path"))
    return g.select("label", "f.caption", tx.short_caption(F.col("f.caption"), F.col("label")).alias("short_caption"), "image_path", "f.page_no")


def footnote_index(units: DataFrame, page: tuple = ("source", "page_no")) -> DataFrame:
    """(page..., notes): texts of the footnotes of each page, in order of their units."""
    n = units.where("unit_type = 'footnote'").select(*page, "unit_no", tx.collapse("text").alias("text")).where("text <> ''")
    return n.groupBy(*page).agg(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", "text"))), lambda x: x["text"]).alias("notes"))


def page_range(pages: DataFrame, first: int, last: int, page: str = "page_no") -> DataFrame:
    """Pages first..last, both included; the filter reaches the scan."""
    return pages.where(F.col(page).between(max(1, first), last))
