"""Counters, gauges and latency summaries: as aggregates over frames, and as text in Prometheus' format."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILES = (0.5, 0.9, 0.99, 0.999)
#: Latencies that a summary keeps for its quantiles.
RECENT = 20_000

# ---------------------------------------------------------------- aggregates


def counters(frame: DataFrame, *labels: str) -> DataFrame:
    """A count for each combination of labels."""
    return frame.groupBy(*labels).agg(F.count("*").alias("value"))


def gauges(frame: DataFrame, value: str, order: Column, *labels: str) -> DataFrame:
    """The last value of each combination of labels."""
    return frame.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


def nearest_rank(frame: DataFrame, value: str, quantiles: Iterable[float], *labels: str) -> DataFrame:
    """Exact percentiles: of n sorted values the one of rank ceil(p * n), per combination of labels.

    Values are counted first, so ranks are running sums over distinct values.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("__upto", F.sum("__c").over(whole.orderBy(value))).withColumn("__n", F.sum("__c").over(whole))
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    asked = ranked.withColumn("quantile", F.explode(points)).withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("__n"))))
    hit = (F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__c") < F.col("__rank"))
    return asked.where(hit).select(*labels, "quantile", F.col(value).alias("value"))


def summaries(frame: DataFrame, value: str, *labels: str) -> DataFrame:
    """Count, sum and exact quantiles per combination of labels: of n sorted values the one of rank ceil(p * n).

    Equal values are counted before they are shuffled, so ranks are running sums over distinct values, and what is
    sorted can spill. Ranks are computed in decimals, as 0.999 * n in doubles may land just above a whole number.
    """
    counts = frame.groupBy(*labels, value).agg(F.count(value).alias("__c"), F.sum(value).alias("__s"))
    whole = Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("__upto", F.sum("__c").over(whole.orderBy(value))).withColumn("__n", F.sum("__c").over(whole))
    shown = []
    for p in QUANTILES:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(p))) * F.col("__n")).cast("long"))
        hit = (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank)
        shown.append(F.max(F.when(hit, F.col(value))).alias(f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}"))
    return ranked.groupBy(*labels).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("count"), F.sum("__s").alias("sum"), *shown)


# ---------------------------------------------------------------- registry and text


def percentile(values: list[float], p: float) -> float:
    """Nearest rank of a list; 0 for an empty one."""
    s = sorted(values)
    return s[max(0, math.ceil(p * len(s)) - 1)] if s else 0.0


@dataclass
class Family:
    """A metric with its labels; values by label values."""

    name: str
    kind: str
    help: str
    labels: tuple[str, ...] = ()
    values: dict[tuple[str, ...], float] = field(default_factory=dict)
    samples: dict[tuple[str, ...], deque[float]] = field(default_factory=dict)
    totals: dict[tuple[str, ...], tuple[int, float]] = field(default_factory=dict)

    def add(self, *labels: str, by: float = 1) -> None:
        self.values[labels] = self.values.get(labels, 0) + by

    def set(self, *labels: str, to: float) -> None:
        self.values[labels] = to

    def observe(self, *labels: str, value: float) -> None:
        """Count and sum cover all values, quantiles the last RECENT ones."""
        self.samples.setdefault(labels, deque(maxlen=RECENT)).append(value)
        count, total = self.totals.get(labels, (0, 0.0))
        self.totals[labels] = count + 1, total + value


#: Families of the service: name, kind, labels, help.
CATALOGUE = (
    ("rpc_requests_total", "counter", ("method", "status"), "Requests handled, by method and result."),
    ("rpc_latency_us", "summary", ("method",), "Request latency in microseconds, by method."),
    ("kafka_messages_consumed_total", "counter", ("table",), "Messages consumed and applied, by table."),
    ("kafka_parse_errors_total", "counter", ("table",), "Messages that could not be parsed, by table."),
    ("kafka_apply_errors_total", "counter", ("table",), "Items that could not be applied, by table."),
    ("kafka_committed_offset", "gauge", ("table",), "Last offset committed, by table."),
    ("kafka_apply_latency_us", "summary", ("table",), "Time to apply a batch in microseconds, by table."),
    ("table_count", "gauge", (), "Tables loaded."),
    ("table_reload_total", "counter", ("table", "result"), "Reloads, by table and result."),
    ("snapshot_bytes", "gauge", ("table",), "Bytes of the active snapshot, by table."),
    ("snapshot_rows", "gauge", ("table",), "Rows of the active snapshot, by table."),
    ("snapshot_versions", "gauge", ("table",), "Versions kept, by table."),
    ("snapshot_pruned_total", "counter", ("table",), "Versions pruned, by table."),
    ("admin_commands_total", "counter", ("cmd", "result"), "Admin commands, by command and result."),
    ("build_info", "gauge", ("version",), "Version as a label; always 1."),
)


class Registry:
    """All families of a process."""

    def __init__(self, prefix: str = "keystrata_") -> None:
        self.families = {name: Family(prefix + name, kind, text, labels) for name, kind, labels, text in CATALOGUE}

    def __getitem__(self, name: str) -> Family:
        return self.families[name]

    def render(self) -> str:
        return "".join(render(f) for f in self.families.values() if f.values or f.samples)


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def _braces(pairs: list[tuple[str, str]]) -> str:
    return "{" + ",".join(f'{k}="{_escaped(v)}"' for k, v in pairs) + "}" if pairs else ""


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def render(f: Family) -> str:
    """A family's lines: help and type once, then a line for each sample."""
    lines = [f"# HELP {f.name} " + f.help.replace("\\", "\\\\").replace("\n", "\\n"), f"# TYPE {f.name} {f.kind}"]
    for labels, value in f.values.items():
        lines.append(f"{f.name}{_braces(list(zip(f.labels, labels, strict=True)))} {_number(value)}")
    for labels, values in f.samples.items():
        own = list(zip(f.labels, labels, strict=True))
        lines += [f"{f.name}{_braces([*own, ('quantile', format(q, 'g'))])} {_number(percentile(values, q))}" for q in QUANTILES]
        count, total = f.totals[labels]
        lines += [f"{f.name}_count{_braces(own)} {count}", f"{f.name}_sum{_braces(own)} {_number(total)}"]
    return "\n".join(lines) + "\n"


def load_report(ok: int, errors: int, found: int, wall_sec: float, latencies_us: list[float]) -> dict:
    """The summary of a load test."""
    return {
        "ok": ok, "errors": errors, "found": found, "not_found": ok - found,
        "qps": round((ok + errors) / wall_sec, 3) if wall_sec else 0.0,
        **{f"p{q * 100:g}_us": percentile(latencies_us, q) for q in QUANTILES},
        "mean_us": sum(latencies_us) / len(latencies_us) if latencies_us else 0.0,
    }
