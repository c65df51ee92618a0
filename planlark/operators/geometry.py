"""Lines, chains, spans and tables of drawings: interval joins, gaps and islands, and grouped dynamic programming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlark.functions import scalars as S
from planlark.operators.relational import box_overlaps, dealt, inside


def distinct_segments(df: DataFrame) -> DataFrame:
    """Segments (page, x0, y0, x1, y1) whatever their direction. G1."""
    a, b = F.struct("x0", "y0"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"))
    return df.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)}).select("page", F.col("__a.x0").alias("x0"), F.col("__a.y0").alias("y0"), F.col("__b.x0").alias("x1"), F.col("__b.y0").alias("y1")).distinct()


def axis(dx: Column, dy: Column, straight: int) -> Column:
    """h or v for lines that lean by at most 1 in ``straight``, else null. G2."""
    x, y = F.abs(dx), F.abs(dy)
    return F.when((x > 0) & (y * straight <= x), "h").when((y > 0) & (x * straight <= y), "v")


def dimension_lines(lines: DataFrame, ticks: DataFrame, tolerance: int, least: int) -> DataFrame:
    """Horizontal lines (page, id, y, x0, x1) of a least span with a witness (page, x, y0, y1) across both ends. G3.

    A tick enters the cells, of sixteen tolerances, that it reaches into: one, or two near a border. A line looks into one cell
    for each end, by a semi join each, so lines are never repeated nor counted."""
    width = 16 * max(tolerance, 1)
    cell = lambda x: F.floor(x / width)
    t = ticks.select("page", "x", "y0", "y1", F.explode(F.array_distinct(F.array(cell(F.col("x") - tolerance), cell(F.col("x") + tolerance)))).alias("cell")).alias("t").hint("merge")
    found = lines.filter(F.col("x1") - F.col("x0") >= least).filter("x0 <> x1").select("page", "id", "y", "x0", "x1")
    for end in ("x0", "x1"):
        near = (F.abs(F.col("t.x") - F.col(f"l.{end}")) <= tolerance) & F.col("l.y").between(F.col("t.y0"), F.col("t.y1"))
        found = found.alias("l").join(t, (F.col("l.page") == F.col("t.page")) & (cell(F.col(f"l.{end}")) == F.col("t.cell")) & near, "left_semi")
    return found.select("page", "id").distinct()


def chains(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, a, b) whose end is the next one's start form a chain; chains of two or more. G4."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    marked = spans.withColumn("__s", F.coalesce(F.lag("b").over(w) != F.col("a"), F.lit(True)).cast("int")).withColumn("chain", F.sum("__s").over(w))
    found = marked.groupBy(*keys, "chain").agg(F.count("*").alias("links"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum(F.col("b") - F.col("a")).alias("length"))
    return found.filter("links >= 2").drop("chain")


def closures(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, parts) of spans that others tile from end to end, the longest step first. G5.

    A key is one drawing line, so its spans are one array; each span walks it with array functions.
    """
    lines = spans.groupBy(*keys).agg(F.collect_set(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("all"))
    each = lines.select(*keys, "all", F.explode("all").alias("o"))

    def step(s: Column, _: Column) -> Column:
        onward = F.filter("all", lambda x: (x["a"] == s["at"]) & (x["b"] <= F.col("o.b")) & (x != F.col("o")))
        to = F.array_max(F.transform(onward, lambda x: x["b"]))
        return F.struct(F.coalesce(to, s["at"]).alias("at"), (s["parts"] + to.isNotNull().cast("int")).alias("parts"))

    start = F.struct(F.col("o.a").alias("at"), F.lit(0).alias("parts"))
    walked = each.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.size("all")), start, step))
    return walked.filter((F.col("w.at") == F.col("o.b")) & (F.col("w.parts") >= 2)).select(*keys, F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.col("w.parts").alias("parts"))


def chain_state(total: Column, parts: Column, n_parts: Column) -> Column:
    """G6."""
    return F.when(total.isNull() | parts.isNull() | (n_parts == 0), "NOT_VERIFIABLE").when(total == parts, "CLOSED").otherwise("NOT_CLOSED")


def containing_span(members: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The shortest span (s_id, s0, s1) that holds each member (m_id, m0, m1): the most specific one; ties are unresolved.
    Members meet only spans that are near, by an interval index. G8, J15."""
    met = inside(members, spans, keys, ("m0", "m1"), ("s0", "s1"))
    w = Window.partitionBy(*keys, "m_id").orderBy(F.col("s1") - F.col("s0"), "s_id")
    seen = met.withColumns({"__n": F.row_number().over(w), "__w": F.lead(F.col("s1") - F.col("s0")).over(w)}).filter("__n = 1")
    tie = F.coalesce(F.col("__w") == F.col("s1") - F.col("s0"), F.lit(False))
    return seen.select(*keys, "m_id", F.when(~tie, F.col("s_id")).alias("s_id"), F.when(tie, "tie").otherwise("contained").alias("state"))


def resolved_spans(lines: DataFrame, items: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """What each dimension line measures: (keys, line, state, item, place), a row for each item of the answer. G8.

    lines: keys (a page and axis), line, a, b; items: keys, item, x0, x1 along the axis, y0, y1 across. ``single``: the one
    item that begins and ends where the line does, or of several the one that lies inside all others; ``run``: items side
    by side, in order, that begin and end with the line. Else one row without an item that says why: ``ambiguous`` (several
    line up, none is inside all others), ``none`` (fewer than two items within), ``short`` (they do not reach both ends),
    ``overlap`` or ``gap`` (between neighbours, beyond the tolerance).

    Items meet lines by the interval index; a line's items are walked in order by one window, never gathered.
    Cases: ends in either order; a line of no items is ``none``; null ends are ``none``; keys compare as equals do.
    """
    t = F.lit(tolerance)
    ends = lines.select(*keys, "line", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    wide = ends.withColumns({"__a": F.col("a") - t, "__b": F.col("b") + t}).filter("a IS NOT NULL AND b IS NOT NULL")
    met = inside(items.select(*keys, "item", "x0", "x1", "y0", "y1"), wide, keys, ("x0", "x1"), ("__a", "__b"))
    aligned = (F.abs(F.col("x0") - F.col("a")) <= t) & (F.abs(F.col("x1") - F.col("b")) <= t)
    met = met.withColumn("aligned", aligned)
    line, order = Window.partitionBy(*keys, "line"), Window.partitionBy(*keys, "line").orderBy("x0", "x1", "item")
    of = lambda f, c: f(F.when(F.col("aligned"), F.col(c))).over(line)
    inmost = F.col("aligned") & (F.col("x0") == of(F.max, "x0")) & (F.col("y0") == of(F.max, "y0")) & (F.col("x1") == of(F.min, "x1")) & (F.col("y1") == of(F.min, "y1"))
    step = F.col("x0") - F.lag("x1").over(order)
    walked = met.withColumns({"inmost": inmost, "step": step, "place": F.row_number().over(order)})
    facts = walked.groupBy(*keys, "line").agg(
        F.count_if("aligned").alias("n_aligned"), F.count_if("inmost").alias("n_inmost"), F.count("*").alias("n"), F.max(F.col("step") < -t).alias("over"), F.max(F.col("step") > t).alias("gap"),
        ((F.abs(F.min("x0") - F.min("a")) <= t) & (F.abs(F.max_by("x1", F.struct("x0", "x1", "item")) - F.min("b")) <= t)).alias("reach"),
    )
    one = F.when(F.col("n_aligned") == 1, "single").when(F.col("n_inmost") == 1, "single").when(F.col("n_aligned") > 1, "ambiguous")
    run = F.when(F.col("n") < 2, "none").when(~F.col("reach"), "short").when(F.col("over"), "overlap").when(F.col("gap"), "gap").otherwise("run")
    states = facts.select(*keys, "line", F.coalesce(one, run).alias("state"), (F.col("n_aligned") == 1).alias("__only"))
    both = walked.join(states.hint("merge"), [*keys, "line"])
    chosen = both.filter(((F.col("state") == "single") & F.when(F.col("__only"), F.col("aligned")).otherwise(F.col("inmost"))) | (F.col("state") == "run"))
    found = chosen.select(*keys, "line", "state", "item", F.when(F.col("state") == "run", F.col("place")).otherwise(1).alias("place"))
    rest = lines.select(*keys, "line").join(states.hint("merge"), [*keys, "line"], "left").withColumn("state", F.coalesce("state", F.lit("none"))).filter(~F.col("state").isin("single", "run"))
    return found.unionByName(rest.select(*keys, "line", "state"), allowMissingColumns=True)


def text_lines(texts: DataFrame, lines: DataFrame, keys: list[str], limit: float, margin: float) -> DataFrame:
    """(keys, text, line, state): the dimension line that each number annotates, or why none. G7.

    texts: keys (a page), text, x, y (the centre of its box), along (h or v, the way it reads), lx, ly (where its leader
    lands, null without one); lines: keys, line, x0, y0, x1, y1. States: ``associated``; ``out_of_range`` (no line within the
    limit); ``no_axis`` (one in range runs equally both ways); ``other_way`` (none in range runs as the text does);
    ``ambiguous`` (the next is not farther than the nearest by more than the margin). With a leader the way does not matter.

    Texts and lines meet in grids of levels, as boxes: a line costs four rows at most, however long it is, and a text four
    for each coarser grid. Each text's few candidates are ranked by one window.
    Cases: ends in either order; a line without length has no axis; a text without a place is out of range; ties of two
    lines are ambiguous.
    """
    at = {"px": F.coalesce("lx", "x").cast("double"), "py": F.coalesce("ly", "y").cast("double")}
    t = texts.select(*keys, "text", "along", F.col("lx").isNotNull().alias("led"), *[v.alias(k) for k, v in at.items()])
    box = t.filter("px IS NOT NULL AND py IS NOT NULL").select(*keys, "text", "along", "led", "px", "py", *[(F.col(c) + d * limit).alias(f"l_{n}") for n, c, d in (("x0", "px", -1), ("y0", "py", -1), ("x1", "px", 1), ("y1", "py", 1))])
    d = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    low = [f(d[a], d[b]).alias(f"r_{n}") for n, f, a, b in (("x0", F.least, "x0", "x1"), ("y0", F.least, "y0", "y1"), ("x1", F.greatest, "x0", "x1"), ("y1", F.greatest, "y0", "y1"))]
    seg = lines.select(*keys, "line", *[v.alias(k) for k, v in d.items()], *low)
    met = box_overlaps(box, seg, tuple(keys), touching=True)
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    runs = F.when(wide > high, "h").when(high > wide, "v")
    near = met.withColumns({"d2": S.segment_distance2(F.col("px"), F.col("py"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]), "runs": runs}).filter(F.col("d2") <= limit * limit)
    fits = F.col("led") | F.coalesce(F.col("runs") == F.col("along"), F.lit(False))
    one = Window.partitionBy(*keys, "text")
    seen = near.withColumn("fits", fits).withColumns({"no_axis": F.max(F.col("runs").isNull()).over(one), "n": F.count_if("fits").over(one)})
    order = one.orderBy(F.desc("fits"), "d2", "line")
    first = seen.withColumns({"k": F.row_number().over(order), "next": F.lead(F.when(F.col("fits"), F.col("d2"))).over(order)}).filter("k = 1")
    excess = F.col("next") - F.col("d2") - margin * margin
    close = F.col("next").isNotNull() & ((excess <= 0) | (excess * excess <= 4 * margin * margin * F.col("d2")))
    state = F.when(~F.col("led") & F.col("no_axis"), "no_axis").when(F.col("n") == 0, "other_way").when(close, "ambiguous").otherwise("associated")
    found = first.select(*keys, "text", "line", state.alias("state"))
    both = texts.select(*keys, "text").join(found.hint("merge"), [*keys, "text"], "left")
    return both.select(*keys, "text", F.when(F.col("state") == "associated", F.col("line")).alias("line"), F.coalesce("state", F.lit("out_of_range")).alias("state"))


def assembly(members: DataFrame, keys: list[str], span0: str, span1: str) -> DataFrame:
    """Whether the members (a, b, id) of a span cover it: in order, no overlap, no gap, both ends, no id twice. G9."""
    members = dealt(members, keys, members.count())
    w = Window.partitionBy(*keys).orderBy("a", "b", "id")
    step = F.col("a") - F.lag("b").over(w)
    marked = members.withColumns({"__gap": F.coalesce(step > 0, F.lit(False)), "__over": F.coalesce(step < 0, F.lit(False))})
    found = marked.groupBy(*keys).agg(F.bool_or("__gap").alias("gap"), F.bool_or("__over").alias("over"), (F.min("a") == F.min(span0)).alias("left"), (F.max("b") == F.max(span1)).alias("right"), (F.count("*") == F.count_distinct("id")).alias("once"), F.count("*").alias("members"))
    state = F.when(~F.col("once"), "duplicate_id").when(F.col("over"), "overlap").when(F.col("gap"), "gap").when(~(F.col("left") & F.col("right")), "short").otherwise("covered")
    return found.select(*keys, "members", state.alias("state"))


def pair_rows(left: DataFrame, right: DataFrame, on: list[str], tolerance: int, margin: int) -> DataFrame:
    """Pairs of tick rows (row, x): support counts coinciding ticks; paired where the best is ahead of the next by the
    margin. Ticks meet in buckets, so rows without a shared tick never do. A tick's rows of either side are sets before they
    are paired, so pairs are counted where they are made and no tick of a pair moves. G10, J16."""
    n = left.count()
    a = dealt(left.select(*on, F.col("x").alias("lx"), "row"), [*on, "lx"], n).groupBy(*on, "lx").agg(F.collect_set("row").alias("l_rows"))
    b = right.select(*on, F.col("row").alias("r_row"), F.col("x").alias("rx"))
    if tolerance:
        cell = lambda c: F.floor(F.col(c) / tolerance)
        near = a.withColumn("cell", F.explode(F.sequence(cell("lx") - 1, cell("lx") + 1))).join(b.withColumn("cell", cell("rx")).hint("merge"), [*on, "cell"]).filter(F.abs(F.col("lx") - F.col("rx")) <= tolerance)
        b = near.select(*on, "lx", "r_row")
    else:
        b = b.withColumnRenamed("rx", "lx")
    b = dealt(b, [*on, "lx"], n).groupBy(*on, "lx").agg(F.collect_set("r_row").alias("r_rows"))
    met = a.join(b.hint("merge"), [*on, "lx"]).select(*on, F.explode("l_rows").alias("l_row"), "r_rows").select(*on, "l_row", F.explode("r_rows").alias("r_row"))
    support = met.groupBy(*on, "l_row", "r_row").agg(F.count("*").alias("support"))
    w = Window.partitionBy(*on, "l_row").orderBy(F.desc("support"), "r_row")
    seen = support.withColumns({"__n": F.row_number().over(w), "__next": F.coalesce(F.lead("support").over(w), F.lit(0))}).filter("__n = 1")
    return seen.select(*on, "l_row", "r_row", "support", F.when(F.col("support") - F.col("__next") >= margin, "paired").otherwise("ambiguous").alias("state"))


def aligned_views(pairs: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """(keys, length, unique): the longest chain of positions (l, r), both rising, whose steps differ by at most the
    stretch; groups are two views of one item. Dynamic programming over one group's positions. G12."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(int(a), int(b)) for a, b in zip(pdf.l, pdf.r, strict=True)})
        best: list[tuple[int, int]] = []
        for i, (a, b) in enumerate(points):
            n, ways = 1, 1
            for j in range(i):
                c, d = points[j]
                if c < a and d < b and abs((a - c) - (b - d)) <= stretch:
                    m = best[j][0] + 1
                    if m > n:
                        n, ways = m, best[j][1]
                    elif m == n and m > 1:
                        ways += best[j][1]
            best.append((n, ways))
        top = max((n for n, _ in best), default=0)
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], top, sum(w for n, w in best if n == top) == 1)], columns=[*keys, "length", "unique"])

    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{fields}, length int, unique boolean")


def grid_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, component): cells that touch, per page (a bounded grid). G13."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo, out = {(int(x), int(y)) for x, y in zip(pdf.x, pdf.y, strict=True)}, []
        n = 0
        for seed in sorted(todo):
            if seed not in todo:
                continue
            stack = [seed]
            todo.discard(seed)
            while stack:
                x, y = stack.pop()
                out.append((*[pdf[k].iloc[0] for k in keys], x, y, n))
                for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if near in todo:
                        todo.discard(near)
                        stack.append(near)
            n += 1
        return pd.DataFrame(out, columns=[*keys, "x", "y", "component"])

    fields = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(run, f"{fields}, x long, y long, component int")


def view_scale(ratios: DataFrame, view: str, ratio: str, percent: int) -> DataFrame:
    """(view, scale, outliers): the median ratio and how many lie off it by more than a percentage. G14, A15."""
    scale = ratios.groupBy(view).agg(F.median(ratio).alias("scale"))
    off = F.abs(F.col(ratio) - F.col("scale")) * 100 > F.col("scale") * percent
    return ratios.join(scale, view).groupBy(view).agg(F.max("scale").alias("scale"), F.count_if(off).alias("outliers"), F.count("*").alias("n"))


def leaders(shapes: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """(keys, id, leader): leader clustering of widths and heights in id order, inside a group of one font. G15."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[int, float, float]] = []
        out = []
        for r in pdf.sort_values("id").itertuples():
            head = next((h for h, w, t in heads if min(w, r.w) >= ratio * max(w, r.w) and min(t, r.h) >= ratio * max(t, r.h)), None)
            if head is None:
                head = r.id
                heads.append((r.id, r.w, r.h))
            out.append((*[getattr(r, k) for k in keys], r.id, head))
        return pd.DataFrame(out, columns=[*keys, "id", "leader"])

    fields = ", ".join(f"{k} {shapes.schema[k].dataType.simpleString()}" for k in keys)
    return shapes.groupBy(*keys).applyInPandas(run, f"{fields}, id long, leader long")


def length_veto(value: Column, drawn: Column, percent: int) -> Column:
    """A sealed value that the drawn length contradicts. G16."""
    return F.when(drawn.isNull() | (drawn <= 0), "unchecked").when(F.abs(value - drawn) * 100 > drawn * percent, "vetoed").otherwise("kept")


def supersession(sheets: DataFrame) -> DataFrame:
    """(sheet, current, state) of (sheet, version, supersedes): ordered only by recorded history; a fork, or several
    starts, is refused. G17."""
    newer = sheets.filter("supersedes IS NOT NULL").groupBy("sheet", "supersedes").count()
    forks = newer.groupBy("sheet").agg(F.max("count").alias("forks"))
    tips = sheets.join(sheets.select("sheet", F.col("supersedes").alias("version")).filter("version IS NOT NULL"), ["sheet", "version"], "left_anti")
    ends = tips.groupBy("sheet").agg(F.count("*").alias("tips"), F.max("version").alias("tip"))
    starts = sheets.groupBy("sheet").agg(F.count_if(F.col("supersedes").isNull()).alias("starts"))
    both = starts.join(ends, "sheet", "left").join(forks, "sheet", "left")
    state = F.when(F.coalesce("forks", F.lit(0)) > 1, "fork").when(F.col("starts") != 1, "unordered").when(F.coalesce("tips", F.lit(0)) != 1, "cycle").otherwise("ordered")
    return both.select("sheet", F.when(state == "ordered", F.col("tip")).alias("current"), state.alias("state"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """(keys, state, differs): rows of one side only, and the attributes in which both differ. G18, W11."""
    a = left.select(*keys, F.struct(*attributes).alias("__l"))
    b = right.select(*keys, F.struct(*attributes).alias("__r"))
    both = a.join(b, keys, "full_outer")
    odd = F.array_compact(F.array(*[F.when(~F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")), F.lit(c)) for c in attributes]))
    state = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(F.size(odd) > 0, "differs").otherwise("same")
    return both.select(*keys, state.alias("state"), F.when(state == "differs", F.array_join(odd, ",")).otherwise("").alias("differs"))


def page_type(dimensions: Column, words: Column, images: Column) -> Column:
    """What a page is, by what is on it. G20."""
    return F.when((dimensions == 0) & (words == 0), F.when(images > 0, "picture").otherwise("blank")).when(dimensions >= 5, "drawing").when(words >= 200, "text").otherwise("other")
