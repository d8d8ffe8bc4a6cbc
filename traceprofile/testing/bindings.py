"""Trace tables derived from the driver's parquet tables.

Every derivation is a projection or a pre-aggregated ``distinct`` over the whole input:
no windows or lists per user, customer or order, so a key that holds a large part of
the input costs nothing extra. A third of all rows lands in the trace ``hot`` on
purpose; the number of other traces grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.functions.predicates import RUNTIME_OVERHEAD_METHOD
from traceprofile.session import materialize, new_shared_path
from traceprofile.sources.trace_files import DEPTH_AT, RECORD_HEADER

CHAIN = 40             # slices per parent chain
TRACE_BLOCK = 10_000   # events per group of four ordinary traces
FILE_SAMPLES = 500     # samples per encoded trace file, at most
MAPPING_FILE_SIZE = 1000

_materialized: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _materialized:
        _materialized[key] = materialize(build(), name)
    return _materialized[key]


def _spread(df: DataFrame) -> DataFrame:
    """Give every core a share when the input is fewer files than cores; an input that
    already has more partitions is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _trace_of_event(event_id: Column) -> Column:
    block = F.floor(event_id / CHAIN)
    group = F.floor(event_id / TRACE_BLOCK) * 4
    return F.when(block % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), (group + block % 4).cast("string"))
    )


def _slice_name(event_type: Column, k: Column) -> Column:
    def numbered(prefix: str, modulus: int, suffix: str) -> Column:
        return F.concat(F.lit(prefix), (k % modulus).cast("string"), F.lit(suffix))

    def cycle(*names: Column | str) -> Column:
        cols = [n if isinstance(n, Column) else F.lit(n) for n in names]
        return F.element_at(F.array(*cols), (k % len(cols) + 1).cast("int"))

    return (
        F.when(event_type == "click", numbered("void com.app.ui.Screen", 7, ".onClick(View)"))
        .when(event_type == "view", cycle(
            "Choreographer#doFrame",
            numbered("void com.app.View", 5, ".performTraversal()"),
            "boolean android.view.View.draw(Canvas)",
        ))
        .when(event_type == "purchase", cycle(
            "void com.app.db.SQLiteOrders.insert(Order)", "Binder transact", "HTTP fetch",
            "void com.app.pay.Checkout.submit()",
        ))
        .when(event_type == "signup", cycle(
            "java.lang.Object kotlin.coroutines.Resume.run()",
            "com.app.Login$submit$1$2.invokeSuspend()",
            "com.app.Login$submit$1.invokeSuspend()",
            "com.app.Login$session$2.invoke()",
            "com.app.Login$1.run()",
            "msdocker.hook.Proxy.call()",
            "com.app.Ill111l.get()",
        ))
        .otherwise(cycle(
            "void com.app.log.FilePrinter.print(String)", "com.app.Foo.a3()",
            "void com.app.data.Profile.load()",
        ))
    )


def _slices(events: DataFrame) -> DataFrame:
    event, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return events.select(
        _trace_of_event(event).alias("trace_id"),
        event.alias("id"),
        (F.col("user_id") + 100_000).alias("track_id"),
        F.when(event % CHAIN != 0, event - 1).alias("parent_id"),
        _slice_name(F.col("event_type"), k).alias("name"),
        (hours * F.lit(3_600_000_000_000)).cast("bigint").alias("ts"),
        (F.floor(F.col("value") / 10) * 20_000_000 + k % 3 * 150_000)
        .cast("bigint").alias("dur"),
    )


def _threads(events: DataFrame) -> DataFrame:
    user = F.col("utid")
    return (
        events.select(
            _trace_of_event(F.col("event_id")).alias("trace_id"), F.col("user_id").alias("utid")
        )
        .distinct()
        .select(
            "trace_id", "utid", (user + 1000).alias("tid"),
            F.when(user % 5 == 0, "main")
            .otherwise(F.concat(F.lit("worker-"), user.cast("string"))).alias("name"),
            F.when(user % 7 == 0, 1).when(user % 7 == 3, None).otherwise(0)
            .cast("int").alias("is_main_thread"),
        )
    )


def slice_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``slice``, ``thread_track``, ``thread`` and ``process`` from ``events``."""
    events = _read(spark, sf_dir, "events")
    thread = _once(spark, sf_dir, "thread", lambda: _threads(events))
    return {
        "slice": _once(spark, sf_dir, "slice", lambda: _spread(_slices(events))),
        "thread": thread,
        "thread_track": _once(
            spark, sf_dir, "thread_track",
            lambda: thread.select("trace_id", (F.col("utid") + 100_000).alias("id"), "utid"),
        ),
        "process": _once(
            spark, sf_dir, "process",
            lambda: thread.filter(F.col("utid") % 11 == 1).select(
                "trace_id", F.col("tid").alias("pid")
            ),
        ),
    }


def _samples(orders: DataFrame) -> DataFrame:
    order, leaf = F.col("o_orderkey"), F.col("o_custkey")
    block = F.floor(order / FILE_SAMPLES)
    group = F.floor(order / 50_000) * 4
    inner = (order % 12).cast("int")
    step = order % 5
    walk = F.transform(
        F.sequence(F.lit(0), inner), lambda i: leaf + i.cast("bigint") * step
    )
    unsigned = F.when(order % 1000 == 17, F.array(-order - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    busy = F.concat(unsigned, walk, F.array(F.lit(1).cast("bigint")))
    idle = F.array(*[F.lit(a).cast("bigint") for a in (3, 2, 1)])
    frames = F.when(order % 3 == 1, idle).otherwise(busy)
    return orders.select(
        F.when(block % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("s"), (group + block % 4).cast("string")))
        .alias("trace_id"),
        order.alias("sample_ord"),
        F.lit(2).cast("int").alias("marker"),
        F.size(frames).alias("depth"),
        frames.alias("frames"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack samples from ``orders``; a third of them are one identical idle stack."""
    return _once(
        spark, sf_dir, "samples", lambda: _spread(_samples(_read(spark, sf_dir, "orders")))
    )


FIXED_NAMES = {
    1: "void android.app.ActivityThread.main(java.lang.String[])",
    2: "void android.os.Looper.loop()",
    3: "android.os.Message android.os.MessageQueue.next()",
}
TAGGED_NAMES = (
    "org.json.JSONObject org.json.JSONObject.put(java.lang.String)",
    "java.lang.Object java.lang.reflect.Method.invoke(java.lang.Object)",
    "void com.vivo.perf.Monitor.tick()",
    "void androidx.room.RoomDatabase.query(java.lang.String)",
    "void android.view.Choreographer.doFrame(long)",
    "void com.app.log.FilePrinter.print(java.lang.String)",
)


def _mapping(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    dotted = F.concat(F.lit("void com.shop."), F.replace("p_name", F.lit(" "), F.lit(".")))
    tagged = F.element_at(
        F.array(*[F.lit(n) for n in TAGGED_NAMES]),
        (F.floor(key / 20) % len(TAGGED_NAMES) + 1).cast("int"),
    )
    name = (
        F.when(key == 1, FIXED_NAMES[1]).when(key == 2, FIXED_NAMES[2])
        .when(key == 3, FIXED_NAMES[3])
        .when(key % 97 == 0, RUNTIME_OVERHEAD_METHOD)
        .when(key % 20 == 11, tagged)
        .when(key % 3 == 0, F.concat(dotted, F.lit(".m"), key.cast("string"), F.lit("()")))
        .otherwise(F.concat(dotted, F.lit("("), F.col("p_brand"), F.lit(")")))
    )
    return part.select(key.alias("addr"), name.alias("name"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol map from all of ``part``; many addresses share a name. Samples also hold
    addresses beyond the last part and negative ones, which no name covers."""
    return _once(spark, sf_dir, "mapping", lambda: _mapping(_read(spark, sf_dir, "part")))


# --- encoded files -------------------------------------------------------------------


def _le_hex(value: Column, size: int) -> Column:
    """Little-endian hex text of an integer in ``size`` bytes."""
    big = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(trace_id, sample_ord, record)``: each sample as the bytes of a record. A frame that is
    NULL has no bytes, a sample without frames or depth no record."""
    for batch in batches:
        n, frames = batch.num_rows, batch.column("frames")
        owner = np.asarray(pc.list_parent_indices(frames)).astype(np.int64)
        values = frames.flatten()
        owner = owner[np.asarray(values.is_valid())]
        values = np.asarray(values.drop_null()).astype("<i8")
        counts = np.bincount(owner, minlength=n)
        offsets = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(RECORD_HEADER + 8 * counts, out=offsets[1:])
        out = np.zeros(offsets[-1], dtype=np.uint8)
        begins = offsets[:-1, None].astype(np.int64)
        marker = np.asarray(batch.column("marker").fill_null(0)).astype("<u2")
        out[begins + np.arange(2)] = marker.view(np.uint8).reshape(n, 2)
        depth = np.asarray(batch.column("depth").fill_null(0)).astype("<u4").view(np.uint8).reshape(n, 4)
        for at in (DEPTH_AT, DEPTH_AT + 4):
            out[begins + np.arange(at, at + 4)] = depth
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        at = offsets[owner] + RECORD_HEADER + 8 * place
        out[at[:, None] + np.arange(8)] = values.view(np.uint8).reshape(-1, 8)
        records = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        whole = pc.and_(pc.and_(frames.is_valid(), batch.column("depth").is_valid()),
                        batch.column("marker").is_valid())
        yield pa.RecordBatch.from_arrays(
            [batch.column("trace_id"), batch.column("sample_ord"),
             pc.if_else(whole, records, pa.scalar(None, pa.binary()))],
            names=["trace_id", "sample_ord", "record"],
        )


def _samples_as_files(samples: DataFrame) -> DataFrame:
    """Trace files of at most ``FILE_SAMPLES`` records, some damaged by rule: a wrong
    signature, ten junk bytes, or junk so long that the scan gives up."""
    block = F.floor(F.col("sample_ord") / FILE_SAMPLES)
    encoded = samples.select("trace_id", "sample_ord", "marker", "depth", "frames").mapInArrow(
        _encode, "trace_id string, sample_ord bigint, record binary"
    )
    files = (
        encoded.select("trace_id", block.alias("block"), "sample_ord", "record")
        .groupBy("trace_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("sample_ord", "record"))).alias("records"))
    )
    block = F.col("block")
    meta = F.concat(F.lit('{"processId":'), (block + 1000).cast("string"), F.lit("}"))
    junk = F.when(block % 9 == 4, 300).when(block % 4 == 1, 10).otherwise(0)
    text = F.concat(
        F.when(block % 7 == 3, "DEADBEEF").otherwise("04030201"), F.lit("00000000"),
        _le_hex(F.lit(5), 4), _le_hex(block * 1_000_000, 8), _le_hex(F.lit(25_000), 4),
        _le_hex(F.length(meta), 4), F.hex(meta), F.repeat(F.lit("00"), junk),
        F.array_join(F.transform("records", lambda r: F.hex(r["record"])), ""),
    )
    return files.select(
        F.concat("trace_id", F.lit("-"), block.cast("string")).alias("trace_id"),
        F.unhex(text).alias("content"),
    )


def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(trace_id, content)`` of encoded sample files."""
    source = samples(spark, sf_dir)
    return _once(spark, sf_dir, "trace_files", lambda: _samples_as_files(source))


def _mapping_as_files(mapping: DataFrame) -> DataFrame:
    """Mapping files of at most ``MAPPING_FILE_SIZE`` addresses. Every fifth address has
    an outdated record first; every other file ends with an empty record and leftovers."""
    def record(name: Column) -> Column:
        return F.concat(
            _le_hex(F.col("addr"), 8), _le_hex(F.octet_length(name), 2), F.hex(name)
        )

    stale = F.when(F.col("addr") % 5 == 0, record(F.lit("void old.Name.gone()"))).otherwise("")
    block = F.floor(F.col("addr") / MAPPING_FILE_SIZE)
    files = (
        mapping.select(
            block.alias("block"), "addr", F.concat(stale, record(F.col("name"))).alias("records")
        )
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("addr", "records"))).alias("r"))
    )
    leftover = F.concat(
        _le_hex(F.lit(0), 8), F.lit("0000"), _le_hex(F.lit(7), 8), F.lit("0100"), F.lit("41")
    )
    text = F.concat(
        F.repeat(F.lit("00"), 8), _le_hex(F.lit(1), 4), _le_hex(F.size("r"), 4),
        F.array_join(F.transform("r", lambda x: x["records"]), ""),
        F.when(F.col("block") % 2 == 0, leftover).otherwise(""),
    )
    return files.select(
        F.concat(F.lit("m"), F.col("block").cast("string")).alias("trace_id"),
        F.unhex(text).alias("content"),
    )


def mapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(trace_id, content)`` of encoded symbol maps."""
    source = mapping(spark, sf_dir)
    return _once(spark, sf_dir, "mapping_files", lambda: _mapping_as_files(source))


def _per_trace_maps(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """One symbol map per trace file, of the addresses its samples hold."""
    file_id = F.concat("trace_id", F.lit("-"), F.floor(F.col("sample_ord") / FILE_SAMPLES).cast("string"))
    used = samples.select(file_id.alias("trace_id"), F.explode("frames").alias("addr")).distinct()
    record = F.concat(
        _le_hex(F.col("addr"), 8), _le_hex(F.octet_length("name"), 2), F.hex("name")
    )
    # encoded before the join: an address is met in many files
    records = mapping.select("addr", record.alias("record"))
    files = used.join(records, "addr").groupBy("trace_id").agg(
        # at most as many records as the samples of one file have frames
        F.sort_array(F.collect_list(F.struct("addr", "record"))).alias("r")
    )
    text = F.concat(
        F.repeat(F.lit("00"), 8), _le_hex(F.lit(1), 4), _le_hex(F.size("r"), 4),
        F.array_join(F.transform("r", lambda x: x["record"]), ""),
    )
    return files.select("trace_id", F.unhex(text).alias("content"))


def _write_files(files: DataFrame, root: str) -> int:
    """Write ``(name, content)`` as files below ``root``, each by the task that holds it."""
    def write(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{folder}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content)
            yield batch.select(["name"])

    return files.select("name", "content").mapInArrow(write, "name string").count()


_folders: dict[tuple[str, str], str] = {}


def trace_folder(spark: SparkSession, sf_dir: str) -> str:
    """A shared folder with ``<trace>/sampling`` and ``<trace>/sampling-mapping`` files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        root = new_shared_path(spark, "trace-folder")
        root = root if "://" in root or root.startswith("file:") else f"file://{root}"
        maps = _per_trace_maps(samples(spark, sf_dir), mapping(spark, sf_dir))
        files = trace_files(spark, sf_dir).select(
            F.concat("trace_id", F.lit("/sampling")).alias("name"), "content"
        ).unionByName(
            maps.select(F.concat("trace_id", F.lit("/sampling-mapping")).alias("name"), "content")
        )
        _write_files(files, root)
        _folders[key] = root
    return _folders[key]


def traces(tables: dict[str, DataFrame]) -> DataFrame:
    """Every trace of a slice model, from its small thread table."""
    return tables["thread"].select("trace_id").distinct()
