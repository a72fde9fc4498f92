"""Counters and gauges from text snapshots of /proc and /sys files: one branch a file, all in built-in functions.

Input: host_id, ts, file (a name of FILES), content. Output: host_id, ts, metric, value, unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field names in file order, fields kept, and what is skipped.
CPU_FIELDS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
NET_FIELDS = (
    "rx_bytes", "rx_packets", "rx_errors", "rx_dropped", "rx_fifo", "rx_frame", "rx_compressed", "rx_multicast", "tx_bytes", "tx_packets",
    "tx_errors", "tx_dropped", "tx_fifo", "tx_collisions", "tx_carrier", "tx_compressed"
)
VMSTAT_FIELDS = (
    "nr_free_pages", "nr_inactive_anon", "nr_active_anon", "nr_inactive_file", "nr_active_file", "nr_unevictable", "nr_slab_reclaimable",
    "nr_slab_unreclaimable", "nr_page_table_pages", "nr_dirty", "nr_writeback", "nr_anon_pages", "nr_mapped", "nr_shmem", "nr_slab",
    "nr_kernel_stack", "nr_pages_scanned", "workingset_refault", "nr_vmscan_write", "nr_vmscan_immediate_reclaim",
)
SWAP_FIELDS = {"nr_swap_pages": "memory.swap_pages", "pswpin": "memory.swap_in", "pswpout": "memory.swap_out", "swap_faults": "memory.swap_faults"}
MEMINFO_FIELDS = {
    "MemTotal": "memory.total", "MemFree": "memory.free", "MemAvailable": "memory.available", "Buffers": "memory.buffers", "Cached": "memory.cached",
    "SwapTotal": "memory.swap_total", "SwapFree": "memory.swap_free", "Mapped": "memory.mapped", "Shmem": "memory.shared", "Slab": "memory.slab",
    "SReclaimable": "memory.slab_reclaimable", "SUnreclaim": "memory.slab_unreclaimable",
    "Tmpfs": "memory.tmpfs",
}
NUMA_FIELDS = {"MemTotal": "total", "MemFree": "free"}
PSEUDO_FILESYSTEMS, PSEUDO_MOUNTS = ("proc", "sysfs", "devpts", "tmpfs", "devtmpfs"), ("/sys", "/proc", "/dev")
FILES = ("stat", "loadavg", "meminfo", "vmstat", "buddyinfo", "pressure_memory", "numa_meminfo", "diskstats", "mounts", "net_dev", "sockstat", "scaling_cur_freq", "thermal_zone")
#: Files that are read whole, not line by line.
WHOLE = ("buddyinfo", "thermal_zone")


METRICS = "array<struct<metric:string,value:double,unit:string>>"


def _fields(line: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(line), ":", " "), r"\s+")


def _at(i: int) -> Column:
    """The i-th field (from 1) as text, null if there is none."""
    return F.try_element_at("f", F.lit(i))


def _num(i: int) -> Column:
    return _at(i).try_cast("double")


def _metrics(*made: tuple[Column, Column, str]) -> Column:
    return F.array(*(F.struct(n.alias("metric"), v.alias("value"), F.lit(u).alias("unit")) for n, v, u in made)).cast(METRICS)


def _renamed(names: dict[str, str], i: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), _at(i))


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *parts)


def _free_pages(content: Column) -> Column:
    """KB in free pages of all zones of a buddyinfo file: its counts in pages of 4 KB."""
    counts = lambda line: F.slice(_fields(line), 5, 99)
    zone = lambda s, line: s + F.aggregate(counts(line), F.lit(0.0), lambda t, x: t + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    zones = F.filter(F.split(content, "\n"), lambda line: F.trim(line).startswith("Node"))
    return F.when(F.size(zones) > 0, F.aggregate(zones, F.lit(0.0), zone) * 4)


def _rules() -> list[tuple[str, Column, Column]]:
    """File, which of its lines, and the metrics of such a line."""
    lit, name = F.lit, _at(1)
    core = F.when(name == "cpu", "total").otherwise(name)
    disk = (("reads", 4, 1, "ops"), ("read_bytes", 6, 512, "B"), ("writes", 8, 1, "ops"), ("write_bytes", 10, 512, "B"), ("io_time", 13, 1, "ms"))
    load = ((1, "1"), (2, "5"), (3, "15"))
    real = ~_at(3).isin(*PSEUDO_FILESYSTEMS) & ~_at(2).rlike(f"^({'|'.join(PSEUDO_MOUNTS)})")
    return [
        (
            "stat", name.startswith("cpu"),
            _metrics(*((_named("cpu.jiffies.", core, lit("." + n)), _num(i + 2), "jiffies") for i, n in enumerate(CPU_FIELDS)))
        ),
        ("stat", name == "ctxt", _metrics((lit("cpu.context_switches"), _num(2), ""))),
        ("stat", name == "intr", _metrics((lit("cpu.interrupts"), _num(2), ""))),
        ("stat", name == "procs_running", _metrics((_named("cpu.", name), _num(2), ""), (lit("cpu.threads"), _num(2), ""))),
        ("stat", name.isin("processes", "procs_blocked"), _metrics((_named("cpu.", name), _num(2), ""))),
        ("loadavg", lit(True), _metrics(*((lit(f"cpu.load_avg_{n}"), _num(i), "") for i, n in load))),
        ("meminfo", name.isin(*MEMINFO_FIELDS), _metrics((_renamed(MEMINFO_FIELDS, 1), _num(2), "KB"))),
        ("vmstat", name.isin(*VMSTAT_FIELDS), _metrics((_named("memory.vmstat_", name), _num(2), ""))),
        ("vmstat", name.isin(*SWAP_FIELDS), _metrics((_renamed(SWAP_FIELDS, 1), _num(2), ""))),
        (
            "pressure_memory", name.isin("some", "full"),
            _metrics((_named("memory.pressure_", name), F.try_element_at(F.split(_at(2), "="), lit(2)).try_cast("double"), "%"))
        ),
        (
            "numa_meminfo", (name == "Node") & _at(3).isin(*NUMA_FIELDS),
            _metrics((_named("memory.numa_", _at(2), lit("."), _renamed(NUMA_FIELDS, 3)), _num(4), "KB"))
        ),
        (
            "diskstats", (F.size("f") >= 14) & ~_at(3).rlike("^(loop|ram)|dm-"),
            _metrics(*((_named(f"disk.{n}.", _at(3)), _num(i) * by, u) for n, i, by, u in disk))
        ),
        ("mounts", real, _metrics((_named("disk.mount.", _at(2)), lit(1.0), ""))),
        (
            "net_dev", _num(2).isNotNull() & (name != "lo"),
            _metrics(*((_named("network.", lit(n + "."), name), _num(i + 2), "") for i, n in enumerate(NET_FIELDS)))
        ),
        ("sockstat", (name == "TCP") & (_at(2) == "inuse"), _metrics((lit("network.connections"), _num(3), "conn"))),
        ("buddyinfo", lit(True), _metrics((lit("memory.free_pages"), _free_pages(F.col("line")), "KB"))),
        ("scaling_cur_freq", lit(True), _metrics((lit("cpu.frequency"), _num(1) / 1000, "MHz"))),  # the file has kHz
        (
            "thermal_zone", F.lower(F.substring_index("line", "\n", 1)).contains("cpu"),
            _metrics((lit("cpu.temperature"), F.trim(F.try_element_at(F.split("line", "\n"), F.lit(2))).try_cast("bigint") / 1000, "°C"))  # thousandths of a degree
        ),
    ]


def parse_host_snapshots(snapshots: DataFrame) -> DataFrame:
    """One pass: every file's lines (buddyinfo, whose zones are summed, and a sensor's type and value as one), each line's
    metrics by its file. Of several sensors and cores each snapshot gives its own row."""
    lines = F.when(F.col("file").isin(*WHOLE), F.array("content")).otherwise(F.split("content", "\n"))
    rows = snapshots.select("host_id", "ts", "file", F.explode_outer(lines).alias("line")).withColumn("f", _fields(F.col("line")))
    made = None
    for file, hit, metrics in _rules():
        fits = (F.col("file") == file) & hit
        made = F.when(fits, metrics) if made is None else made.when(fits, metrics)
    rows = rows.select("host_id", "ts", F.explode_outer(made).alias("m")).select("host_id", "ts", "m.metric", "m.value", "m.unit")
    return rows.where(F.col("value").isNotNull() & F.col("metric").isNotNull())
