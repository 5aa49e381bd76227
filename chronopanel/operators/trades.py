"""Fixed-margin chains over any number of units: rounds in which random pairs of rows trade columns, as Spark stages.

In a round every row meets one other, and the two deal anew the columns that only one of them has, each keeping its number. Columns' sums
can't change, and who meets whom doesn't depend on the matrix, so a round is as likely backwards as forwards and the chain is uniform
over all matrices of these margins. All randomness is MD5 of (seed, round, unit): a stage that is repeated makes the same trades.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalar import GAP_CATEGORIES
from chronopanel.operators import randomization
from chronopanel.operators.randomization import CATEGORIES
from chronopanel.sources import files
from chronopanel.sources.tables import shared_path

#: Rows that are put in order together, about; rows meet within such a block.
BLOCK_ROWS = 4096
#: Rounds of one plan; then the state is written.
ROUNDS_A_PLAN = 8
#: Columns that a mask has room for.
MOST_COLUMNS = 63


def digits(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Leading hexadecimal digits of a row's key that name its block, so that blocks have at most ``block_rows`` rows on average."""
    d = 0
    while rows > block_rows * 16**d:
        d += 1
    return d


def begun(matrix: DataFrame, chains: DataFrame) -> DataFrame:
    """The state of chains (chain, seed, ...) before their first round on a matrix (su_id, mask) of one row a unit.

    size is the row's number of ones, which draws are held against; met and moved count the rounds in which the row had a partner, and those that changed it.
    """
    zero = F.lit(0).cast("long")
    rows = matrix.select("su_id", "mask", F.bit_count("mask").alias("size"), zero.alias("met"), zero.alias("moved"))
    return rows.join(F.broadcast(chains.select("chain", "seed")))


def trade_round(state: DataFrame, number: int, columns: int, key_digits: int) -> DataFrame:
    """The state after round ``number``: rows are in the order of their key within blocks, and the 1st meets the 2nd, the 3rd the 4th, and so on.

    One exchange; what the two have both and what neither has stays. Of the other columns, in the order of their own hashes, the first of the two
    takes as many as it brought. The last row of an odd block stays as it is.
    """
    if columns > MOST_COLUMNS:
        raise ValueError(f"{columns} columns; a mask holds {MOST_COLUMNS}")
    name = lambda *parts: F.md5(F.concat_ws("|", F.col("seed"), F.lit(number), *parts))
    block = Window.partitionBy("chain", "block").orderBy("key", "su_id")
    row = F.struct("su_id", "mask")
    placed = state.withColumn("key", name(F.col("su_id"))).withColumn("block", F.substring("key", 1, key_digits))
    placed = placed.withColumns({"first": F.row_number().over(block) % 2 == 1, "after": F.lead(row).over(block), "before": F.lag(row).over(block)})
    other = F.when(F.col("first"), F.col("after")).otherwise(F.col("before"))
    paired = placed.withColumn("other", other).withColumns({
        "either": F.coalesce(F.col("mask").bitwiseXOR(F.col("other.mask")), F.lit(0)),
        "leader": F.when(F.col("first"), F.col("su_id")).otherwise(F.col("other.su_id")),
        "brought": F.bit_count(F.when(F.col("first"), F.col("mask").bitwiseAND(F.bitwise_not(F.col("other.mask")))).otherwise(F.col("other.mask").bitwiseAND(F.bitwise_not(F.col("mask"))))),
    })
    bits = F.filter(F.array(*[F.lit(1 << c).cast("long") for c in range(columns)]), lambda b: F.col("either").bitwiseAND(b) != 0)
    dealt = F.array_sort(F.transform(bits, lambda b: F.struct(name(F.col("leader"), b).alias("h"), b.alias("b"))))
    taken = F.aggregate(F.slice(dealt, 1, F.coalesce(F.col("brought"), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["b"]))
    # the second of the two has what the first leaves
    own = taken.bitwiseXOR(F.when(F.col("first"), F.lit(0).cast("long")).otherwise(F.col("either")))
    new = F.when(F.col("other").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseAND(F.bitwise_not(F.col("either"))).bitwiseOR(own))
    out = paired.withColumn("new", new)
    return out.select("su_id", F.col("new").alias("mask"), "size", (F.col("met") + F.col("other").isNotNull().cast("long")).alias("met"), (F.col("moved") + (F.col("new") != F.col("mask")).cast("long")).alias("moved"), "chain", "seed")


def column_sums(matrix: DataFrame, columns: int) -> list[int]:
    """Ones of each column of a matrix (su_id, mask)."""
    return list(matrix.agg(*[F.coalesce(F.sum((F.col("mask").bitwiseAND(1 << c) != 0).cast("long")), F.lit(0)).alias(f"c{c}") for c in range(columns)]).first())


def _categories(years: list[int], missing: Iterable[int]) -> list[int]:
    """Of year i and last active year j, at i * len(years) + j: the category's number from 1, or 0 where there is no gap or a missing year in it."""
    out = []
    for year in years:
        for last in years:
            crossing = any(last < m < year for m in missing)
            fits = [k for k, (_, most) in enumerate(GAP_CATEGORIES, 1) if most is None or year - last <= most]
            out.append(0 if crossing or year <= last else fits[0])
    return out


def gap_counts(state: DataFrame, draw: int, years: list[int], missing: list[int], ones: list[int]) -> DataFrame:
    """The state as the rows of a draw (chain, draw, gap_time_category, n_risk, active, attempted, accepted, margins_kept).

    Attempted and accepted are trades of pairs. Rows are counted by (chain, column) where they are, so what is exchanged doesn't grow with units.
    """
    width = len(years)
    at = lambda values, i: F.get(F.array(*[F.lit(v).cast("long") for v in values]), i)
    i = F.col("i")
    each = state.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    earlier = F.col("mask").bitwiseAND(at([(1 << c) - 1 for c in range(width)], i))
    each = each.withColumns({"hit": (F.col("mask").bitwiseAND(at([1 << c for c in range(width)], i)) != 0).cast("long"), "last": F.when(earlier != 0, F.length(F.bin(earlier)) - 1)})
    each = each.withColumn("category", F.coalesce(at(_categories(years, missing), i * width + F.col("last")), F.lit(0)))
    once = lambda c: F.sum(F.when(i == 0, c).otherwise(0))
    here = lambda k, c: F.sum(F.when(F.col("category") == k, c).otherwise(0))
    numbers = range(1, len(CATEGORIES) + 1)
    years_of = each.groupBy("chain", "i").agg(
        F.sum("hit").alias("ones"), once(F.col("met")).alias("met"), once(F.col("moved")).alias("moved"), F.bool_and(F.bit_count("mask") == F.col("size")).alias("rows_kept"),
        *[here(k, F.lit(1)).alias(f"n{k}") for k in numbers], *[here(k, F.col("hit")).alias(f"a{k}") for k in numbers],
    )
    kept = F.bool_and(F.col("rows_kept") & (F.col("ones") == at(ones, i)))
    whole = years_of.groupBy("chain").agg(kept.alias("margins_kept"), F.sum("met").alias("met"), F.sum("moved").alias("moved"), *[F.sum(f"{x}{k}").cast("long").alias(f"{x}{k}") for x in "na" for k in numbers])
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n{k}").alias("n"), F.col(f"a{k}").alias("a")) for k, c in zip(numbers, CATEGORIES, strict=True)]))
    half = lambda c: (F.col(c) / 2).cast("long")
    return whole.withColumn("x", found).select("chain", F.lit(draw).alias("draw"), F.col("x.c").alias("gap_time_category"), F.col("x.n").alias("n_risk"), F.col("x.a").alias("active"), half("met").alias("attempted"), half("moved").alias("accepted"), "margins_kept")


class Traders:
    """Chains (chain, seed, n_draws) on a matrix (su_id, mask): ``burn_in`` rounds, then ``thin`` rounds before each draw.

    All chains take a round together, one exchange of (chains x units) short rows, so many chains cost no more stages than one. The state is written
    every ROUNDS_A_PLAN rounds and before a draw is counted; the table before it goes then. Memory of a task is a block of rows, whatever
    the number of units. A matrix without rows has no draws; a chain without draws takes part in no round.
    """

    def __init__(self, matrix: DataFrame, chains: DataFrame, years: list[int], missing: list[int], burn_in: int, thin: int, block_rows: int = BLOCK_ROWS):
        self.matrix, self.chains, self.years, self.missing, self.burn_in, self.thin = matrix, chains, sorted(years), missing, burn_in, thin
        self.digits = digits(matrix.count(), block_rows)
        self.ones = column_sums(matrix, len(self.years))

    def take(self, first: int, n: int, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Draws ``first`` to ``first + n - 1`` and the state after them, from the state before (None at the beginning); both rest on tables in the shared folder."""
        spark = self.matrix.sparkSession
        if n <= 0:
            return spark.createDataFrame([], randomization.DRAWS), begun(self.matrix, self.chains) if state is None else state
        draws_path, before = shared_path(spark, "trade-draws"), None
        state = begun(self.matrix, self.chains) if state is None else state
        number = (self.burn_in if first else 0) + first * self.thin
        for draw in range(first, first + n):
            going = self.chains.where(F.col("n_draws") > draw).select("chain")
            state = state.join(F.broadcast(going), "chain", "left_semi")
            end = self.burn_in + (draw + 1) * self.thin
            while True:
                upto = min(end, number + ROUNDS_A_PLAN)
                for r in range(number, upto):
                    state = trade_round(state, r, len(self.years), self.digits)
                path, number = shared_path(spark, "trade-state"), upto
                state.write.parquet(path)
                state = spark.read.schema(state.schema).parquet(path)
                if before:
                    files.remove(spark, before)
                before = path
                if number == end:
                    break
            gap_counts(state, draw, self.years, self.missing, self.ones).write.mode("append").parquet(draws_path)
        return spark.read.parquet(draws_path), state


def traded_chains(matrix: DataFrame, chains: DataFrame, years: list[int], missing: list[int], burn_in: int, thin: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All draws of chains (chain, seed, n_draws) on a matrix (su_id, mask)."""
    most = chains.agg(F.max("n_draws")).first()[0] or 0
    return Traders(matrix, chains, years, missing, burn_in, thin, block_rows).take(0, most)[0]
