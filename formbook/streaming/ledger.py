"""T5: the sequential bid ledger as a Structured Streaming stateful job.

Every accepted bid changes the purse, squad and ownership that later bids of
its auction are judged by. A bid carries its place in its auction (``seq``,
1 to n without gaps), so the order lies in the data: files may arrive in any
order and any number of times. The ledger is keyed by ``auction_id`` and
runs as ``transformWithStateInPandas`` with typed state:

* ``expected``: the place the auction waits for;
* ``franchise``: what each franchise spent and bought in the auction;
* ``owned``: names bought in the auction (both are lists, read and written in
  one call each: a call to the state costs more than judging a bid);
* ``waiting``: bids that came before their turn, by place.

A bid whose place is past is a re-delivery and gives no row. Snapshot
counters are joined onto each bid beforehand (``bids.bid_context``), so the
state holds the auction's own purchases only, which purses and squad caps
bound. Money is counted in whole hundredths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from formbook.operators import bids as B
from formbook.session import checkpoint_dir, cut_lineage

LEDGER_SCHEMA = StructType([
    StructField("bid_id", LongType()), StructField("auction_id", LongType()),
    StructField("franchise_id", LongType()), StructField("pool_id", LongType()),
    StructField("price_cr", DoubleType()), StructField("player_name", StringType()),
    StructField("accepted", BooleanType()), StructField("result_status", StringType()),
    StructField("purse_after_cr", DoubleType()),
])
#: What a bid is judged by; a bid that waits is kept whole.
BID_COLUMNS = ("seq long, bid_id long, franchise_id long, pool_id long, price_cr double, player_name string, "
               "franchise_known boolean, player_known boolean, owned_at_snapshot boolean, purse_remaining_cr double, "
               "squad_size long, max_squad_size long, is_overseas boolean, overseas_count long, max_overseas long, "
               "base_price_cr double")
BID_NAMES = [c.split()[0] for c in BID_COLUMNS.split(", ")]
BID_KINDS = [{"long": int, "double": float, "string": str, "boolean": bool}[c.split()[1]] for c in BID_COLUMNS.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hundredths(amount: float) -> int:
    return round(float(amount) * 100)


class AuctionLedger(StatefulProcessor):
    """Judges the bids of an auction one after the other."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "seq long")
        self.franchise = handle.getListState("franchise", "franchise_id long, spent long, bought long, overseas long")
        self.owned = handle.getListState("owned", "name string")
        self.waiting = handle.getMapState("waiting", "seq long", ", ".join(BID_COLUMNS.split(", ")[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = self.expected.exists()
        turn = self.expected.get()[0] if begun else 1
        self.counts = {row[0]: list(row[1:]) for row in self.franchise.get()} if begun else {}
        self.taken = {row[0] for row in self.owned.get()} if begun else set()
        self.bought: list[tuple[str]] = []
        out, early = [], {}
        for frame in rows:
            for bid in frame[BID_NAMES].sort_values("seq").itertuples(index=False):
                seq = int(bid.seq)
                if seq > turn:
                    early[seq] = bid
                elif seq == turn:
                    out.append(self.judged(key[0], bid))
                    turn += 1
            while turn in early or begun and self.waiting.containsKey((turn,)):
                out.append(self.judged(key[0], early.pop(turn) if turn in early else self.recalled(turn)))
                turn += 1
        for seq, bid in early.items():
            if seq > turn:
                # a frame holds whole numbers beside nulls as doubles
                self.waiting.updateValue((seq,), tuple(None if pd.isna(v) else kind(v) for v, kind in zip(bid[1:], BID_KINDS[1:])))
        if self.bought:
            self.owned.appendList(self.bought)
            self.franchise.put([(franchise_id, *count) for franchise_id, count in self.counts.items() if count[1]])
        self.expected.update((turn,))
        if out:
            yield pd.DataFrame(out, columns=LEDGER_SCHEMA.names)

    def recalled(self, seq: int):
        bid = self.waiting.getValue((seq,))
        self.waiting.removeKey((seq,))
        return pd.Series((seq, *bid), index=BID_NAMES)

    def judged(self, auction_id: int, bid) -> tuple:
        """The bid's ledger row; an accepted one enters the state."""
        accepted, status, after = False, None, None
        if not bid.franchise_known:
            status = "blocked: " + B.R_UNKNOWN_TEAM
        elif not bid.player_known:
            status = "blocked: " + B.R_UNKNOWN_PLAYER
        else:
            count = self.counts.setdefault(int(bid.franchise_id), [0, 0, 0])
            spent, bought, overseas = count
            name = (bid.player_name or "").lower()
            price, left = hundredths(bid.price_cr), hundredths(bid.purse_remaining_cr) - spent
            broken = [reason for reason, holds in (
                (B.R_OWNED, bid.owned_at_snapshot or name in self.taken),
                (B.R_PURSE, price > left),
                (B.R_SQUAD, bid.squad_size + bought >= bid.max_squad_size),
                (B.R_OVERSEAS, bid.is_overseas and bid.overseas_count + overseas >= bid.max_overseas),
                (B.R_BASE, price < hundredths(bid.base_price_cr))) if holds]
            accepted, status = not broken, "blocked: " + "; ".join(broken) if broken else "success"
            if accepted:
                left -= price
                count[:] = [spent + price, bought + 1, overseas + int(bool(bid.is_overseas))]
                self.taken.add(name)
                self.bought.append((name,))
            after = left / 100
        name = None if pd.isna(bid.player_name) else bid.player_name
        return (int(bid.bid_id), auction_id, int(bid.franchise_id), int(bid.pool_id), float(bid.price_cr), name,
                accepted, status, after)

    def close(self) -> None:
        pass


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range sorted by auction plus ``_range`` and the place in the
    auction within the range."""
    here, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        auction = batch.column("auction_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, auction[1:] != auction[:-1]))
        sizes = np.diff(np.append(starts, len(auction)))
        place = np.arange(1, len(auction) + 1) - np.repeat(starts, sizes)
        if auction[0] == last:
            place[:sizes[0]] += count
        last, count = auction[-1], int(place[-1])
        yield batch.append_column("_range", pa.array(np.full(len(auction), here))).append_column("seq", pa.array(place))


def sequenced(ctx: DataFrame) -> DataFrame:
    """``ctx`` plus ``seq``, the bid's place in its auction by bid_id; an
    auction of any size is numbered by ranges. Only auctions that go on from
    an earlier range, one a range at most, are counted on, so no bid is
    joined by its auction."""
    rows = ctx.withColumns({c: F.col(c).cast("bigint") for c in ("auction_id", "bid_id")}).where("auction_id IS NOT NULL")
    ranges = int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.schema.fields, StructField("_range", LongType()), StructField("seq", LongType())])
    local = cut_lineage(rows.repartitionByRange(ranges, "auction_id", "bid_id").sortWithinPartitions("auction_id", "bid_id")
                        .mapInArrow(placed, schema))
    before = F.sum("_n").over(Window.partitionBy("auction_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    earlier = (local.groupBy("auction_id", "_range").agg(F.max("seq").alias("_n")).withColumn("_before", before)
               .where("_before > 0").select("auction_id", "_range", "_before"))
    return (local.join(F.broadcast(earlier), ["auction_id", "_range"], "left")
            .withColumn("seq", F.col("seq") + F.coalesce("_before", F.lit(0))).drop("_range", "_before"))


def land_bids(ctx: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> StructType:
    """Write the sequenced bids as they lie, in ranges of auctions and of at
    most ``rows_per_file`` rows a file, so that an auction's bids come in one
    file or in following ones; returns their schema."""
    kinds = dict(c.split() for c in BID_COLUMNS.split(", ")) | {"auction_id": "long"}
    rows = sequenced(ctx).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    rows.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(folder)
    return rows.schema


def judge_landed(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str,
                 files_per_trigger: int = 64) -> None:
    """Judge what has landed in ``folder`` since the last call and append the
    ledger rows to ``target``. The state store is a setting of the stream's
    own session, so the caller's other streams keep theirs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    judged = stream.groupBy("auction_id").transformWithStateInPandas(AuctionLedger(), LEDGER_SCHEMA, "append", "none")
    (judged.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def run_bid_ledger(spark: SparkSession, ctx: DataFrame, work_dir: str | None = None,
                   rows_per_file: int = 1_000_000, files_per_trigger: int = 64) -> DataFrame:
    """Land the bids, judge them all, return the ledger table."""
    root = work_dir or f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    schema = land_bids(ctx, f"{root}/bids", rows_per_file)
    judge_landed(spark, f"{root}/bids", schema, f"{root}/ledger", f"{root}/_checkpoint", files_per_trigger)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/ledger")
