"""Queries on stored samples, envelopes, snapshots and messages."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gaugework.model import hosts, messages, samples, table
from gaugework.plans.filters import CANON, HOSTS, raw_names
from gaugework.plans.series import END, START, bounds
from gaugework.registry import query
from gaugework.session import qualified, work_dir
from gaugework.sources import collectors as C
from gaugework.sources import envelopes as E
from gaugework.sources import hosts as J
from gaugework.sources import kafka, procfs
from gaugework.sources import samples as S
from gaugework.sources.store import Store

ALL = "host_id, metric, ts, value, '' AS unit, seq"


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE host_id IN ('host-1', 'host-2', 'host-3') AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def read_samples(spark, sf_dir):
    path = work_dir(spark, "samples")
    S.write_samples(samples(spark, sf_dir), path)
    return S.read_samples(spark, path, ("host-1", "host-2", "host-3"), *bounds_text())


def bounds_text():
    return tuple(datetime.datetime.fromisoformat(t) for t in (START, END))


@query("WITH {S} SELECT host_id, metric, ts, CASE WHEN seq % 5 = 0 THEN value + 1 ELSE value END AS value, '' AS unit, CASE WHEN seq % 5 = 0 THEN seq + 1000000000 ELSE seq END AS seq FROM s")
def write_samples(spark, sf_dir):
    path, s = work_dir(spark, "samples"), samples(spark, sf_dir)
    S.write_samples(s, path)
    S.write_samples(s.where("seq % 5 = 0").withColumns({"value": F.col("value") + 1, "seq": F.col("seq") + 1_000_000_000}), path)
    return S.read_samples(spark, path)


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE (host_id, ts) NOT IN (SELECT (host_id, ts) FROM s WHERE value > 100)")
def delete_points(spark, sf_dir):
    path, s = work_dir(spark, "samples"), samples(spark, sf_dir)
    S.write_samples(s, path)
    S.delete_points(spark, path, s.where("value > 100"))
    return S.read_samples(spark, path)


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE date_trunc('day', ts) NOT IN (SELECT date_trunc('day', min(ts)) FROM s)")
def delete_day(spark, sf_dir):
    """The first day of the table loses all its scrapes; then the store is compacted."""
    path, s = work_dir(spark, "samples"), samples(spark, sf_dir)
    S.write_samples(s, path)
    first = s.agg(F.min(F.to_date("ts")).alias("day"))
    S.delete_points(spark, path, s.join(F.broadcast(first), F.to_date("ts") == F.col("day"), "left_semi"))  # one row
    Store(spark, path).compact()
    return S.read_samples(spark, path)


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE ts >= TIMESTAMP '{END}' - INTERVAL 7 DAY")
def apply_retention(spark, sf_dir):
    return S.apply_retention(samples(spark, sf_dir), bounds()[1])


@query(f"WITH {{S}} SELECT seq FROM s WHERE seq % 4 = 0 OR ts + INTERVAL 3 DAY > TIMESTAMP '{END}'")
def expire_keys(spark, sf_dir):
    s = samples(spark, sf_dir)
    return S.expire_keys(s.withColumn("expires_at", F.when(s["seq"] % 4 != 0, s["ts"] + F.expr("INTERVAL 3 DAYS"))), bounds()[1]).select("seq")


def payloads(spark, sf_dir):
    """Events as envelopes in three shapes by turns, each with parts that must go."""
    e = table(spark, sf_dir, "events")
    host = F.concat(F.lit("host-"), e["user_id"].cast("string"))
    value, seconds = e["value"].cast("decimal(18,2)").cast("string"), F.unix_seconds(e["ts"].cast("timestamp")).cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    listed = F.format_string(
        '{"host_id":"%s","timestamp":"%s","metrics":[{"name":"%s","value":"%s","unit":"u"},{"name":"","value":"1"},{"name":"bad","value":"x"}],"tags":{"a":"1","":"2","b":""}}',
        host, stamp, "event_type", value
    )
    objects = F.format_string('{"hostId":"%s","timestamp":%s,"metrics":{"%s":{"value":%s,"unit":"%%"}}}', host, seconds, "event_type", value)
    numbers = F.format_string('{"host_id":"%s","timestamp":%s,"metrics":{"%s":%s,"n":"oops"}}', host, seconds, "event_type", value)
    turn = e["event_id"] % 4
    return e.select(
        e["event_id"].alias("seq"),
        F.when(turn == 0, listed).when(turn == 1, objects).when(turn == 2, numbers).otherwise('{"host_id":"h","metr').alias("payload")
    )


@query(
    """WITH {S} SELECT host_id, metric, date_trunc('second', ts)::TIMESTAMP AS ts, value, CASE seq % 4 WHEN 0 THEN 'u' WHEN 1 THEN '%' ELSE '' END AS unit, seq, CASE WHEN seq % 4 = 0 THEN '{"a":"1"}' END AS tags FROM s WHERE seq % 4 <> 3"""
)
def explode_envelopes(spark, sf_dir):
    return E.explode_envelopes(payloads(spark, sf_dir)).withColumn("tags", F.to_json("tags"))


def daily(spark, sf_dir):
    """The greatest whole value of each series and day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")
    return samples(spark, sf_dir).groupBy(
        "host_id", day, "metric"
    ).agg(F.max(F.floor("value")).cast("double").alias("value")).withColumn("unit", F.lit(""))


@query(
    """WITH {S}, m AS (SELECT host_id, date_trunc('day', ts)::TIMESTAMP AS ts, metric, max(CAST(floor(value) AS BIGINT)) AS v FROM s GROUP BY ALL)
    SELECT host_id, CAST(epoch(ts) AS BIGINT) AS timestamp, '[' || string_agg('{"name":"' || metric || '","value":' || v || '.0,"unit":""}', ',' ORDER BY metric) || ']' AS metrics FROM m GROUP BY ALL"""
)
def build_envelopes(spark, sf_dir):
    return E.build_envelopes(daily(spark, sf_dir))


def sent(messages):
    """The metrics of live messages, a row each."""
    data = "struct<host_id:string,timestamp:bigint,metrics:array<struct<name:string,value:double,unit:string>>>"
    m = messages.select("host_id", F.from_json("message", f"struct<type:string,data:{data}>").alias("m"))
    return m.select("host_id", "m.type", "m.data.timestamp", F.col("m.data.host_id").alias("of"), F.inline("m.data.metrics"))


@query(f"WITH {{S}}, {CANON} SELECT host_id, 'metrics' AS type, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, host_id AS of, metric AS name, value, unit FROM c")
def live_push(spark, sf_dir):
    return sent(E.live_messages(raw_names(spark, sf_dir))).withColumn("value", F.round("value", 12))


@query(
    """WITH {S}, m AS (SELECT host_id, date_trunc('day', ts)::TIMESTAMP AS ts, metric, max(CAST(floor(value) AS BIGINT)) AS v FROM s GROUP BY ALL)
    SELECT host_id AS key, '{"host_id":"' || host_id || '","timestamp":' || CAST(epoch(ts) AS BIGINT) || ',"metrics":[' || string_agg('{"name":"' || metric || '","value":' || v || '.0,"unit":""}', ',' ORDER BY metric) || ']}' AS value FROM m GROUP BY host_id, ts"""
)
def encode_messages(spark, sf_dir):
    return kafka.encode_messages(E.scrapes(daily(spark, sf_dir)))


# The fields of the stat and net_dev files.
JIFFIES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
NET = (
    "rx_bytes", "rx_packets", "rx_errors", "rx_dropped", "rx_fifo", "rx_frame", "rx_compressed", "rx_multicast", "tx_bytes", "tx_packets",
    "tx_errors", "tx_dropped", "tx_fifo", "tx_collisions", "tx_carrier", "tx_compressed"
)
#: For each kind of file (by event_id, in turns) its text, with %s for a number, and the metrics in it as (name, value in SQL, unit).
KINDS = (
    (
        "meminfo", "MemTotal:  1000000 kB\nMemFree: %s0 kB\nDirectMap4k: 5 kB\nSReclaimable: %s kB",
        [("memory.total", "1000000", "KB"), ("memory.free", "v * 10", "KB"), ("memory.slab_reclaimable", "v", "KB")]
    ),
    ("loadavg", "0.50 %s.25 %s.00 2/300 4711", [("cpu.load_avg_1", "0.5", ""), ("cpu.load_avg_5", "v + 0.25", ""), ("cpu.load_avg_15", "v", "")]),
    ("diskstats", "   8  0 sda %s 1 %s 4 7 6 8 9 0 11 12\n 7 0 loop0 1 1 1 1 1 1 1 1 1 1 1\n 253 0 dm-0 1 1 1 1 1 1 1 1 1 1 1",
        [
            ("disk.reads.sda", "v", "ops"), ("disk.read_bytes.sda", "v * 512", "B"), ("disk.writes.sda", "7", "ops"),
            ("disk.write_bytes.sda", "4096", "B"), ("disk.io_time.sda", "11", "ms")
        ]),
    ("sockstat", "sockets: used 300\nTCP: inuse %s orphan 0", [("network.connections", "v", "conn")]),
    (
        "pressure_memory", "some avg10=%s.50 avg60=0.00 total=1\nfull avg10=0.25 avg60=0.00 total=1",
        [("memory.pressure_some", "v + 0.5", "%"), ("memory.pressure_full", "0.25", "%")]
    ),
    ("stat", "cpu  %s 1 2 3 4 5 6 7 0 0\ncpu0 %s 1 2 3 4 5 6 7 0 0\nintr 99 1 2\nctxt 17\nbtime 5\nprocesses 12\nprocs_running 2\nprocs_blocked 0",
        [(f"cpu.jiffies.{c}.{n}", "v" if i == 0 else str(i), "jiffies") for c in ("total", "cpu0") for i, n in enumerate(JIFFIES)]
        + [
            ("cpu.interrupts", "99", ""), ("cpu.context_switches", "17", ""), ("cpu.processes", "12", ""), ("cpu.procs_running", "2", ""), ("cpu.threads", "2", ""),
            ("cpu.procs_blocked", "0", "")
        ]),
    (
        "vmstat", "nr_free_pages %s\nnr_other 3\npswpin 7\nnr_dirty %s",
        [("memory.vmstat_nr_free_pages", "v", ""), ("memory.swap_in", "7", ""), ("memory.vmstat_nr_dirty", "v", "")]
    ),
    ("buddyinfo", "Node 0, zone DMA 1 %s 2\nNode 0, zone Normal 3 0 %s", [("memory.free_pages", "(v + v + 6) * 4", "KB")]),
    (
        "numa_meminfo", "Node 0 MemTotal: 500 kB\nNode 0 MemFree: %s kB\nNode 1 MemFree: %s kB\nNode 0 Active: 3 kB",
        [("memory.numa_0.total", "500", "KB"), ("memory.numa_0.free", "v", "KB"), ("memory.numa_1.free", "v", "KB")]
    ),
    (
        "mounts", "/dev/sda1 /data ext4 rw 0 0\nproc /proc proc rw 0 0\ntmpfs /run tmpfs rw 0 0\n/dev/sdb /dev/x ext4 rw 0 0",
        [("disk.mount./data", "1", "")]
    ),
    (
        "net_dev",
        "Inter-|   Receive    |  Transmit\n face |bytes packets |bytes packets\n    lo: " + "1 " * 16 + "\n  eth0: %s 2 3 4 5 6 7 8 %s 10 11 12 13 14 15 16",
        [(f"network.{n}.eth0", "v" if i in (0, 8) else str(i + 1), "") for i, n in enumerate(NET)]
    ),
    ("scaling_cur_freq", "%s500\n", [("cpu.frequency", "v + 0.5", "MHz")]),
    ("thermal_zone", "x86_CPU_temp\n%s250\n", [("cpu.temperature", "v + 0.25", "°C")]),
    ("thermal_zone", "acpitz\n%s000\n", [("never", "NULL", "")]),
)
METRIC = "{'m': '%s', 'v': CAST(%s AS DOUBLE), 'u': '%s'}"
OF_KIND = " UNION ALL ".join(
    f"SELECT host_id, ts, unnest([{', '.join(METRIC % m for m in made)}]) AS x FROM i WHERE kind = {k}" for k, (_, _, made) in enumerate(KINDS) if made[0][0] != "never"
)
SNAPSHOTS = f"i AS (SELECT event_id % {len(KINDS)} AS kind, 'host-' || user_id AS host_id, ts, CAST(floor(value) AS BIGINT) AS v FROM events), m AS ({OF_KIND})"


def snapshots(spark, sf_dir):
    """Events as text snapshots of files, all kinds by turns."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("string"))
    kind = F.col("event_id") % len(KINDS)
    file = F.element_at(F.array(*(F.lit(n) for n, _, _ in KINDS)), (kind + 1).cast("int"))
    content = F.coalesce(*(
        F.when(kind == k, F.format_string(t, *["v"] * t.count("%s")) if "%s" in t else F.lit(t)) for k, (_, t, _) in enumerate(KINDS)
    ))
    return e.select(F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host_id"), "ts", file.alias("file"), content.alias("content"))


@query(f"WITH {SNAPSHOTS} SELECT host_id, ts, x.m AS metric, round(CAST(x.v AS DOUBLE), 4) AS value, x.u AS unit FROM m")
def parse_host_snapshots(spark, sf_dir):
    return procfs.parse_host_snapshots(snapshots(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query(
    """SELECT event_id AS id, CAST(event_id % 5 + CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS retries,
      CASE WHEN event_id % 9 = 0 THEN 'dead' WHEN event_id % 3 = 2 AND event_id % 5 + 1 > 3 THEN 'dead' WHEN event_id % 3 = 2 THEN 'retry' ELSE 'done' END AS route FROM events"""
)
def dead_letters(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("status", F.when(F.col("id") % 3 == 2, "failed").otherwise("processed"))
    return E.dead_letters(m).select("id", "retries", "route")


@query(f"WITH {HOSTS} SELECT host_id, hostname, ip, cpu_count FROM h WHERE ord % 300 <= 255")
def hosts_json(spark, sf_dir):
    path, rows = work_dir(spark, "hosts"), hosts(spark, sf_dir)
    J.write_hosts_json(rows, path)
    return J.read_hosts_json(spark, path, rows.schema).select("host_id", "hostname", "ip", "cpu_count")


@query("WITH {S} SELECT host_id, metric, ts, value, '' AS unit, seq FROM s")
def registered_source(spark, sf_dir):
    J.register_source("events", lambda session: samples(session, sf_dir))
    return J.read_source(spark, "events")


class EventsCollector(C.Collector):
    """The events of a Parquet table as samples: a part is a row group whose times can match, by the file's own statistics."""

    name = "gaugework_events"

    def parts(self, wanted):
        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        top = fs.get_file_info(root)
        files = [root] if top.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
        found = []
        for path in files:
            with fs.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index("ts")
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                first, last = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                if wanted.may_hold(*(t if t is None else t.replace(tzinfo=None) for t in (first, last))):
                    found.append((path, g))
        return found

    def read(self, part, wanted):
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        with fs.open_input_file(part[0]) as f:
            for rows in pq.ParquetFile(f).iter_batches(row_groups=[part[1]], columns=["event_id", "user_id", "event_type", "ts", "value"]):
                host = pc.binary_join_element_wise("host-", pc.cast(rows.column("user_id"), pa.string()), "")
                yield pa.RecordBatch.from_pydict({
                    "host_id": host, "metric": rows.column("event_type"), "ts": rows.column("ts"), "value": rows.column("value"),
                    "unit": pa.repeat("", rows.num_rows), "seq": rows.column("event_id")
                })


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE metric IN ('click', 'error') AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def registered_collector(spark, sf_dir):
    C.register_collector(spark, EventsCollector)
    rows = C.collected(spark, EventsCollector.name, path=qualified(spark, f"{sf_dir}/events.parquet"))
    return rows.where(F.col("metric").isin("click", "error") & F.col("ts").between(*(F.lit(t).cast("timestamp_ntz") for t in bounds_text())))
