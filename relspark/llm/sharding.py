"""Balanced label propagation: linked documents move towards their neighbours' shards while
every shard keeps its number of rows.

Documents that share a link key (equal texts, in the registered query) are neighbours.  The
start is a balanced deal: documents in hash order, one to each shard in turn, so shard sizes
differ by one at most.  Each round counts every link's members by shard (pre-aggregated map
side, so one link may hold any share of the rows), takes the ``ceil(members / quota)`` fullest
shards as the link's homes (ties drawn anew each round), and lets members elsewhere ask for a home.
Moves happen only as exchanges, which is what keeps the sizes: first two askers in opposite
directions, then an asker against a row of the wanted shard that loses less than the asker gains: an
unlinked one, one that is away from its own home, or a member of a weaker link; the largest gains
first, the smallest losses first.  In a round half of the rows may ask there and the other half may
be asked, by a hash, so no row moves twice.  Rounds go on until ``PATIENCE`` of them in a row have
not brought the cut links below the fewest so far; the state with the fewest is the result.  Exchanges are
matched inside ``(shard, salt)`` groups of bounded size.  DataFrame functions only; each round's
state is a written table, deleted when the next one stands.

Cases: a null text counts as empty (size 16, CRC 0, and equal to the empty text).  Repeated
``doc_id`` and equal rows are placed row by row.  An empty table gives no rows.  Fewer
documents than shards leave shards empty.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import forget, stored

PATIENCE = 3  # rounds without fewer cut links, after which the search ends
GROUP_ROWS = 50_000  # rows meant to meet in one matching or numbering group
TASK_ROWS = 10_000  # rows meant for a task that writes a round's table


def _tasks(total: int) -> int:
    """Tasks for a table of ``total`` narrow rows: the many rounds pay for each task, however many
    partitions a shuffle has."""
    return total // TASK_ROWS + 1


def start_state(vertices: DataFrame, shards: int, total: int) -> DataFrame:
    """``vertices`` (``row_id``, ``order``, ``link``) with ``label``: dealt in turn in the order of
    ``order``, numbered by bucket offsets, so no single task sees all rows."""
    buckets = max(1, -(-total // GROUP_ROWS))
    v = vertices.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sizes = v.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("order", "row_id")) - 1 + F.col("before")
    return v.join(before, "bucket").select("row_id", "order", "link", F.pmod(number, F.lit(shards)).cast("int").alias("label"))


def members_by_shard(state: DataFrame) -> DataFrame:
    """``link, label, n`` of the linked rows."""
    return state.where("link is not null").groupBy("link", "label").agg(F.count(F.lit(1)).alias("n"))


def ranked_links(state: DataFrame, shards: int, total: int, turn: int) -> DataFrame:
    """``link``, its shards as ``all``, the fullest first, those of them that are its ``homes`` and the
    number of its rows that are ``apart`` from them; one entry for each shard at most."""
    by_shard = members_by_shard(state).coalesce(_tasks(total))
    entry = F.struct("n", F.xxhash64("link", "label", F.lit(turn)).alias("draw"), "label")
    ranked = by_shard.groupBy("link").agg(F.sum("n").alias("members"), F.reverse(F.array_sort(F.collect_list(entry))).alias("all"))
    ranked = ranked.withColumn("homes", F.slice("all", F.lit(1), F.ceil(F.col("members") / max(1, total // shards)).cast("int")))
    apart = F.col("members") - F.aggregate("homes", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return ranked.select("link", "all", "homes", apart.alias("apart")).coalesce(_tasks(total))


def one_round(state: DataFrame, ranked: DataFrame, shards: int, total: int, turn: int) -> DataFrame:
    """One round of requests and exchanges; the number of rows of every label stays."""
    spark = state.sparkSession
    salts = max(1, total // (shards * GROUP_ROWS))
    salt = F.pmod(F.xxhash64("row_id", F.lit(turn)), F.lit(salts)).alias("salt")
    asks = F.pmod(F.xxhash64("row_id", F.lit(turn), F.lit(5)), F.lit(2)) == 0
    # ranked is stored, so that the join is between two exchanges and a hot link's rows can be split
    linked = state.where("link is not null").join(ranked, "link")
    home = F.get("homes", F.pmod(F.xxhash64("row_id", F.lit(7)), F.size("homes")).cast("int"))
    placed = stored(spark, linked.select(
        "row_id", "label", salt, asks.alias("asks"), F.exists("homes", lambda x: x["label"] == F.col("label")).alias("settled"),
        F.filter("all", lambda x: x["label"] == F.col("label"))[0]["n"].alias("own"), home["label"].alias("dst"), home["n"].alias("there"),
    ).coalesce(_tasks(total)), "shard-asks")
    asking = placed.where("not settled").select("row_id", "salt", "asks", "own", F.col("label").alias("src"), "dst", (F.col("there") - F.col("own")).alias("gain"))
    # both directions between two shards meet in one group
    asking = asking.withColumns({"low": F.least("src", "dst"), "high": F.greatest("src", "dst"), "down": (F.col("src") > F.col("dst")).cast("long")})
    between = Window.partitionBy("salt", "low", "high")
    asking = asking.withColumns({"both": F.count(F.lit(1)).over(between), "downs": F.sum("down").over(between)})
    first = Window.partitionBy("salt", "low", "high", "src").orderBy(F.desc("gain"), "row_id")
    opposite = F.when(F.col("down") == 1, F.col("both") - F.col("downs")).otherwise(F.col("downs"))
    asking = asking.withColumn("k", F.row_number().over(first)).withColumn("swapped", F.col("k") <= opposite)
    asking = stored(spark, asking.select("row_id", "salt", "asks", "own", "src", "dst", "gain", "swapped").coalesce(_tasks(total)), "shard-asks")
    swaps = asking.where("swapped").select("row_id", F.col("dst").alias("to"))
    # what leaves for an asker: unlinked rows cost nothing, rows away from home little
    none = F.lit(None)
    rest = asking.where("not swapped and asks").select("row_id", "salt", "dst", F.lit(-1).alias("away"), "src", "gain", none.cast("long").alias("loss"))
    spare = [
        state.where("link is null").select("row_id", salt, F.col("label").alias("dst"), F.lit(0).alias("away"), F.lit(0).cast("long").alias("loss")),
        asking.where("not swapped and not asks").select("row_id", "salt", F.col("src").alias("dst"), F.lit(1).alias("away"), F.col("own").alias("loss")),
        placed.where("settled and not asks").select("row_id", "salt", F.col("label").alias("dst"), F.lit(2).alias("away"), F.col("own").alias("loss")),
    ]
    meet = rest
    for part in spare:
        meet = meet.unionByName(part.withColumns({"src": none.cast("int"), "gain": none.cast("long")}))
    # one exchange: the k-th asker for a shard meets the k-th row that may leave it
    meet = meet.repartition("salt", "dst").withColumn("asker", F.col("away") < 0)
    turns = Window.partitionBy("salt", "dst", "asker").orderBy("away", F.desc("gain"), "loss", "row_id")
    meet = meet.withColumn("k", F.row_number().over(turns))
    pair = Window.partitionBy("salt", "dst", "k")
    meet = meet.withColumns({c: F.max(c).over(pair) for c in ("src", "gain", "loss")})
    # the sum of squared counts grows by 2 * (gain + 2 - loss) at least
    moves = meet.where("loss < gain + 2").select("row_id", F.when(F.col("asker"), F.col("dst")).otherwise(F.col("src")).alias("to"))
    moved = state.join(swaps.unionByName(moves.coalesce(_tasks(total))), "row_id", "left").select("row_id", "order", "link", F.coalesce("to", "label").alias("label"))
    after = stored(spark, moved.coalesce(_tasks(total)), "shard-state")
    forget(placed, asking)
    return after


def propagate(vertices: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """``(row_id, label)`` of ``vertices`` (``row_id`` unique, ``order`` long, ``link``: null or a key
    that neighbours share).  Label sizes differ by one at most.  ``rounds`` at most, if given."""
    spark = vertices.sparkSession
    total = vertices.count()
    links = vertices.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link")
    links = stored(spark, links.withColumn("shared", F.lit(True)).coalesce(_tasks(total)), "shard-links")
    linked = vertices.join(links, "link", "left")
    lone = linked.select("row_id", "order", F.when(F.col("shared"), F.col("link")).alias("link"))
    state = stored(spark, start_state(lone, shards, total).coalesce(_tasks(total)), "shard-state")
    forget(links)
    best, fewest, idle, turn = None, None, 0, 0
    while True:
        ranked = stored(spark, ranked_links(state, shards, total, turn), "shard-homes")
        apart = _apart(ranked)
        idle = 0 if fewest is None or apart < fewest else idle + 1
        if fewest is None or apart < fewest:
            if best is not None:
                forget(best)
            best, fewest = state, apart
        if not apart or idle >= PATIENCE or turn == rounds:
            break
        after = one_round(state, ranked, shards, total, turn)
        forget(ranked, *([] if state is best else [state]))
        state, turn = after, turn + 1
    forget(ranked, *([] if state is best else [state]))
    return best


def _apart(ranked: DataFrame) -> int:
    """Linked rows outside the fullest shards that their link needs at least."""
    return ranked.agg(F.coalesce(F.sum("apart"), F.lit(0))).first()[0]


def number_slots(placed: DataFrame, total: int) -> DataFrame:
    """``placed`` (``label``, ``order``, ``row_id``) with ``slot``, gapless from 0 inside each label."""
    buckets = max(1, -(-total // GROUP_ROWS))
    p = placed.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sizes = p.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("label").orderBy("bucket")
    before = sizes.select("label", "bucket", (F.sum("rows").over(w) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("order", "row_id"))
    return p.join(before, ["label", "bucket"]).withColumn("slot", F.col("before") + inside - 1).drop("bucket", "before")


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int | None = None, key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` shards of equal row counts (one apart at most),
    equal texts together as far as a shard's quota lets them: ``key``, ``size``, ``text_crc32``,
    ``shard``, ``slot``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("row_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("link"),
    )
    # the row's number too, so that a repeated id is no group of its own
    base = stored(spark, base.withColumn("order", F.xxhash64("key", "row_id")), "shard-base")
    total = base.count()
    state = propagate(base.select("row_id", "order", "link"), shards, rounds)
    placed = number_slots(state.select("row_id", "order", "label"), total)
    return base.select("key", "row_id", "size", "text_crc32").join(placed, "row_id").select(
        F.col("key").alias(key), "size", "text_crc32", F.col("label").alias("shard"), F.col("slot").cast("long").alias("slot"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: ``linked`` documents and how many stand outside their link's fullest shard
    (``placed``: ``link``, ``label``; a null link does not count)."""
    by = placed.where("link is not null").groupBy("link", "label").agg(F.count(F.lit(1)).alias("n"))
    per = by.groupBy("link").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return per.agg(F.sum("all").alias("linked"), F.sum(F.col("all") - F.col("most")).alias("apart"))
