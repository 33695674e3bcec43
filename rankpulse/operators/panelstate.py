"""Panels that grow by days: what a day's rows come to, in a form that later days and coarser periods are merged from.

A state is two tables. `items` has, for each list, day and topic, sums and the items as bits of a number (64 items a row), `values` a histogram of the
figures. Both add up: states of other days, or of other rows of a day, are put beside each other, and a panel of weeks, months or years comes from
them exactly as from the rows, medians and distinct items included, without a look at the rows.

Where items are sparse a row has one item and takes no more than that item's row. Items without
number have no bit, as they aren't distinct items of the direct panel; rows without rank or figure count for the items only. With the dimension
"tag_u" rows without a topic go. A state holds for the figure and the top_n that it was made with. An empty state gives an empty panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpulse.operators.heat import median_of, running_counts
from rankpulse.operators.panel import GROUP, LIST, with_shares
from rankpulse.sources.shared import dealt

_KEYS = "platform string, rank_family string, rank_sub_cat string, topic string"
#: Columns of a state's tables, the day last, by which they are stored.
STATE = {
    "items": f"{_KEYS}, bucket long, items long, top long, n_ranks long, rank_sum double, n_figures long, figure_sum double, figure_min double, period date",
    "values": f"{_KEYS}, figure double, n long, period date",
}

State = dict[str, DataFrame]


#: Binary logarithm of the items of a row.
BITS = 6


def _bits(has: Column) -> Column:
    """The items that have it, of those of a bucket."""
    bit = F.expr(f"shiftleft(1L, cast(novel_uid & {(1 << BITS) - 1} as int))")
    return F.coalesce(F.bit_or(F.when(has, bit)), F.lit(0).cast("long"))


def panel_state(df: DataFrame, dim: str = "tag_u", top_n: int = 10, metric: str = "heat_raw") -> State:
    """The state of the rows of a long table with periods and topics, day by day."""
    rows = df.filter(F.col(dim).isNotNull()).withColumns({"topic": F.col(dim), "figure": F.col(metric).cast("double"), "bucket": F.shiftright("novel_uid", BITS)})
    columns = rows.select(*GROUP, "topic", "bucket", "novel_uid", "rank", "figure")
    items = dealt(columns, "bucket").groupBy("bucket", *GROUP, "topic").agg(
        _bits(F.lit(True)).alias("items"),
        _bits(F.col("rank") <= top_n).alias("top"),
        F.count("rank").alias("n_ranks"),
        F.sum(F.col("rank").cast("double")).alias("rank_sum"),
        F.count("figure").alias("n_figures"),
        F.sum("figure").alias("figure_sum"),
        F.min("figure").alias("figure_min"),
    )
    values = rows.filter("figure is not null").groupBy(*GROUP, "topic", "figure").agg(F.count(F.lit(1)).alias("n"))
    ordered = lambda name: [c.split(" ")[0] for c in STATE[name].split(", ")]
    return {"items": items.select(*ordered("items")), "values": values.select(*ordered("values"))}


def merge_states(state: State, grain: str = "day") -> State:
    """The state of coarser periods; with "day" rows of the same day become one. What it gives is a state again."""
    period = F.col("period") if grain == "day" else F.to_date(F.date_trunc(grain, "period"))
    at = {name: df.withColumn("period", period) for name, df in state.items()}
    sums = [F.sum(c).alias(c) for c in ("n_ranks", "rank_sum", "n_figures", "figure_sum")]
    either = [F.bit_or(c).alias(c) for c in ("items", "top")]
    items = dealt(at["items"], "bucket").groupBy("bucket", *GROUP, "topic").agg(*either, *sums, F.min("figure_min").alias("figure_min"))
    values = at["values"].groupBy(*GROUP, "topic", "figure").agg(F.sum("n").alias("n"))
    return {"items": items.select(*state["items"].columns), "values": values.select(*state["values"].columns)}


def panel_of(state: State, dim: str = "tag_u", grain: str = "day") -> DataFrame:
    """The panel that `panel.period_panel` gives of the rows, from their state; columns and rows are the same."""
    merged = merge_states(state, grain)
    items, tag = merged["items"], dim == "tag_u"
    mean = lambda total, n: F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    distinct = lambda bits: F.sum(F.bit_count(bits).cast("long"))
    panel = items.groupBy(*GROUP, "topic").agg(
        distinct("items").alias("book_count"),
        mean("rank_sum", "n_ranks").alias("avg_rank"),
        mean("figure_sum", "n_figures").alias("avg_heat_raw"),
        F.min("figure_min").alias("entry_threshold"),
        distinct("top").alias("top_app_count"),
    )
    # an item with several topics is one item of its list
    whole = items.groupBy("bucket", *GROUP).agg(F.bit_or("items").alias("items"))
    # as one column: parts of a struct may be null and are equal then
    totals = whole.groupBy(F.struct(*GROUP).alias("_list")).agg(distinct("items").alias("books_in_group"))
    panel = panel.withColumn("_list", F.struct(*GROUP)).join(totals, "_list")
    columns = [*LIST, "period", F.col("topic").alias(dim), "book_count", "avg_rank", "avg_heat_raw"]
    if not tag:
        return with_shares(panel.select(*columns, "entry_threshold", "books_in_group"), dim)
    group = F.struct(*GROUP, "topic").alias("_group")
    histogram = merged["values"].select(group, "figure", "n")
    medians = median_of(running_counts(histogram, "figure", ["_group"]), "figure", "median_heat_raw", ["_group"])
    panel = panel.withColumn("_group", group).join(medians, "_group", "left")
    return with_shares(panel.select(*columns, "median_heat_raw", "entry_threshold", "top_app_count", "books_in_group"), dim)
