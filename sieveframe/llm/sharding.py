"""Sharding by histogram sort: exact bytes below candidate boundaries decide the splitters, then one exchange.

The key is (order column, row number of the written table), so it is unique and even one hot value of the order
column can be split. Boundaries are refined like digits: each round counts the exact bytes of the rows in every
still open interval by the next eight bits of the key, and the target is looked up in the running sums, until the
bytes below a boundary are within the tolerance of their target. Only sums for at most ``SUMS`` candidate boundaries
reach the driver in a round, whatever the input. Every shard is cut into parts in the same way; a part is one key range,
exchanged once and sorted, so slots follow the key through the whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, materialise, tidy

SIGN = -(1 << 63)
DIGIT = 8
#: Sums that may reach the driver in one round of refinement.
SUMS = 1 << 20
#: A shard has this many parts at least; the rows of a part are sorted together.
MIN_PARTS = 4


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _digits(rows: DataFrame, key: str, size: str, prefixes: set[int], shift: int, width: int) -> dict[int, dict]:
    """prefix -> {digit: (bytes, rows)} of the rows whose key starts with the prefix, for each open prefix."""
    head = F.shiftrightunsigned(key, shift + width) if shift + width < 64 else F.lit(0).cast("long")
    found = (
        rows.select(F.col(key), F.col(size), head.alias("head"))
        .filter(F.col("head").isin([_signed(p) for p in prefixes]))
        .groupBy("head", F.shiftrightunsigned(key, shift).bitwiseAND((1 << width) - 1).alias("digit"))
        .agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    )
    out: dict[int, dict] = {p: {} for p in prefixes}
    for x in found.collect():  # SUMS rows at most
        out[_unsigned(x[0])][x[1]] = (x[2], x[3])
    return out


def _search(rows: DataFrame, key: str, size: str, targets: dict[int, int], top: int, slack: int) -> dict[int, tuple]:
    """Boundaries by the 64-bit column ``key`` (its order unsigned, all values below 2**top).

    targets: name -> bytes wanted below its boundary. Returns name -> (boundary, bytes below it, settled?): settled is
    False where several rows share the one value at the boundary and hold more than the slack.
    """
    open_at = {n: (0, 0) for n in targets}  # prefix, bytes below it
    done, shift = {}, top
    while open_at and shift:
        width = min(DIGIT, shift, max(1, (SUMS // len(open_at)).bit_length() - 1))
        shift -= width
        sums = _digits(rows, key, size, {p for p, _ in open_at.values()}, shift, width)
        still = {}
        for n, (prefix, below) in open_at.items():
            base = prefix << width
            for digit, (held, count) in sorted(sums[prefix].items()):
                over, under = below + held - targets[n], targets[n] - below
                if over < 0:
                    below += held
                elif min(over, under) <= slack or count == 1:  # the nearer side of this digit
                    up = over < under
                    done[n] = ((base + digit + up) << shift, below + held * up, True)
                    break
                else:
                    still[n] = (base + digit, below)
                    break
            else:
                done[n] = ((base + (1 << width)) << shift, below, True)
        open_at = still
    return done | {n: (p, below, False) for n, (p, below) in open_at.items()}


@tidy
def histogram_shards(
    docs: DataFrame,
    n_shards: int,
    size: str = "size",
    order: str = "doc_id",
    tolerance: float = 0.001,
    parts_per_shard: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (int, 0 to n_shards - 1), ``slot`` (long, gapless from 0 in each shard).

    ``size`` names a long column with a row's bytes (null counts as 0), ``order`` the integral column by which shards
    are ordered (null first). The bytes of every shard differ from total / n_shards by at most ``tolerance`` of that
    plus one row. Rows with equal order values, even identical ones, are told apart by their place in the written
    table. Slots follow (order, place). An empty table gives no row; with fewer rows than shards, some shards stay empty.
    Own columns named shard or slot are replaced, all others come back as they are.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    hi, lo, mass = (free_name(docs, c) for c in ("hi", "lo", "mass"))
    rows = materialise(
        docs.select(
            *kept,
            F.coalesce(F.col(order).cast("long"), F.lit(SIGN)).bitwiseXOR(F.lit(SIGN)).alias(hi),
            F.monotonically_increasing_id().alias(lo),
            F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(mass),
        ),
        "rows-to-shard",
    )
    total, count, least, most = rows.agg(
        F.sum(mass), F.count("*"), F.min(F.col(hi).bitwiseXOR(F.lit(SIGN))), F.max(F.col(hi).bitwiseXOR(F.lit(SIGN)))
    ).first()
    if parts_per_shard is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts_per_shard = max(MIN_PARTS, -(-4 * tasks // n_shards))
    n_parts = n_shards * parts_per_shard
    cuts = _cuts(rows, hi, lo, mass, total, least, most, n_parts, tolerance * parts_per_shard) if count else []

    part, at, before = (free_name(docs, c) for c in ("part", "at", "before"))
    placed = rows.withColumn(part, _cut_number(cuts, hi, lo))
    order_in = Window.partitionBy(part).orderBy(F.col(hi).bitwiseXOR(F.lit(SIGN)), lo)
    earlier = Window.partitionBy(F.floor(F.col(part) / parts_per_shard)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A row per part. Written, so that its size is known when the join is planned.
    bases = materialise(
        placed.groupBy(part).agg(F.count("*").alias(at)).select(part, F.coalesce(F.sum(at).over(earlier), F.lit(0)).alias(before)).coalesce(1),
        "part-bases",
    )
    return (
        placed.withColumn(at, F.row_number().over(order_in))
        .join(bases, part)
        .select(*kept, F.floor(F.col(part) / parts_per_shard).cast("int").alias("shard"), (F.col(before) + F.col(at) - 1).alias("slot"))
    )


def _cuts(rows, hi, lo, mass, total, least, most, n, tolerance) -> list[tuple[int, int]]:
    """The ascending (hi, lo) boundaries between n ranges of the key."""
    slack = int(tolerance * total / n / 2)
    wanted = {k: total * k // n for k in range(1, n)}
    least, most = least - SIGN, most - SIGN  # in unsigned order
    top = (least ^ most).bit_length()
    base = (least >> top) << top
    low = free_name(rows, "low")
    rows = rows.withColumn(low, F.col(hi).bitwiseXOR(F.lit(_signed(base))))
    found: dict[int, tuple[int, int]] = {}
    tied: dict[int, dict[int, int]] = {}
    for k, (value, below, exact) in _search(rows, low, mass, wanted, top, slack).items():
        if exact:
            found[k] = (base + value, 0) if base + value < 1 << 64 else ((1 << 64) - 1, (1 << 63) - 1)
        else:
            tied.setdefault(value, {})[k] = wanted[k] - below
    for value, inside in tied.items():  # one value with more than the slack: its rows are told apart by their number
        own = rows.filter(F.col(low) == F.lit(_signed(value)))
        last = own.agg(F.max(lo)).first()[0] or 0
        for k, (number, _, _) in _search(own, lo, mass, inside, max(last.bit_length(), 1), slack).items():
            found[k] = (base + value, number)
    out: list[tuple[int, int]] = []
    for k in sorted(found):
        out.append(max(found[k], out[-1]) if out else found[k])
    return out


def _cut_number(cuts: list[tuple[int, int]], hi: str, lo: str) -> Column:
    """How many cuts are at or below the row's key, by binary search: one step for each bit of their number."""
    if not cuts:
        return F.lit(0)
    key = F.struct(F.col(hi).bitwiseXOR(F.lit(SIGN)).alias("value"), F.col(lo).alias("number"))
    values, numbers = (F.array(*(F.lit(x).cast("long") for x in xs)) for xs in zip(*((_signed(v ^ (1 << 63)), n) for v, n in cuts)))
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))

    def further(found: Column, step: Column) -> Column:
        nth = found + step  # from 1
        cut = F.struct(F.get(values, nth - 1).alias("value"), F.get(numbers, nth - 1).alias("number"))
        return F.when((nth <= len(cuts)) & (cut <= key), nth).otherwise(found)

    return F.aggregate(steps, F.lit(0), further)
