"""Rules that judge one run against its baseline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verdicts, and the limits that part them. Deviations are in percent,
# success rates are shares between 0 and 1, rates are multiples of the usual one.
EXCELLENT_BELOW, GOOD_BELOW, NORMAL_BELOW = -20, 10, 50
EXCELLENT, GOOD, NORMAL, SLOW = "Excelente", "Bueno", "Normal", "Lento"
STEADY_DURATION, STEADY_ROWS = 10, 15
ANOMALOUS_DURATION, ANOMALOUS_ROWS = 30, 50
STABLE, ANOMALY, VARIANCE = "STABLE", "ANOMALY", "NORMAL VARIANCE"
OPTIMAL_RATE, DEGRADED_RATE = 1.2, 0.7
OPTIMAL, DEGRADED, ACCEPTABLE = "OPTIMAL", "DEGRADED", "ACCEPTABLE"
ALERT_DURATION, WARNING_DURATION, CONCERN_RATE = 100, 50, 0.80
ALERT, WARNING, CONCERN, ALL_CLEAR = "ALERT", "WARNING", "CONCERN", "ALL CLEAR"
GROWING_ROWS, SLOW_SECONDS, FEW_ROWS = 2, 300, 10_000
GROWTH_TIP = "Data volume is growing. Consider batch processing or incremental sync."
THROUGHPUT_TIP = "Low throughput detected. Check network latency and query optimization."
STABLE_VOLUME = 0.1
VERY_STABLE_RATE, STABLE_RATE = 0.95, 0.80
VERY_STABLE, FAIRLY_STABLE, UNSTABLE = "excelente estabilidad", "estabilidad aceptable", "necesita atención"
SLOWER_DURATION, FASTER_DURATION, GROWTH_ROWS = 50, -30, 100


def deviation_percent(value: Column, average: Column) -> Column:
    """Percent above (or below) the average; 0 where there is no average."""
    return F.when(average > 0, (value - average) / average * 100).otherwise(F.lit(0.0))


def performance_class(duration_deviation: Column) -> Column:
    return (
        F.when(duration_deviation < EXCELLENT_BELOW, EXCELLENT)
        .when(duration_deviation < GOOD_BELOW, GOOD)
        .when(duration_deviation < NORMAL_BELOW, NORMAL)
        .otherwise(SLOW)
    )


def run_pattern(duration_deviation: Column, rows_deviation: Column) -> Column:
    steady = (F.abs(duration_deviation) < STEADY_DURATION) & (F.abs(rows_deviation) < STEADY_ROWS)
    odd = (duration_deviation > ANOMALOUS_DURATION) | (rows_deviation > ANOMALOUS_ROWS)
    return F.when(steady, STABLE).when(odd, ANOMALY).otherwise(VARIANCE)


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; runs under a second count as one."""
    return rows / F.greatest(seconds, F.lit(1.0))


def throughput_class(rate: Column, usual_rate: Column) -> Column:
    fast, slow = rate > usual_rate * OPTIMAL_RATE, rate < usual_rate * DEGRADED_RATE
    return F.when(fast, OPTIMAL).when(slow, DEGRADED).otherwise(ACCEPTABLE)


def alerts(duration_deviation: Column, success_rate: Column) -> Column:
    """All alerts that hold: at most one on the duration, and one on the success rate."""
    slow = F.when(duration_deviation > ALERT_DURATION, ALERT).when(duration_deviation > WARNING_DURATION, WARNING)
    raised = F.array_compact(F.array(slow, F.when(success_rate < CONCERN_RATE, CONCERN)))
    return F.when(F.size(raised) > 0, raised).otherwise(F.array(F.lit(ALL_CLEAR)))


def run_tip(rows: Column, average_rows: Column, seconds: Column) -> Column:
    """Advice on one run, or NULL."""
    growing = rows > average_rows * GROWING_ROWS
    crawling = (seconds > SLOW_SECONDS) & (rows < FEW_ROWS)
    return F.when(growing, GROWTH_TIP).when(crawling, THROUGHPUT_TIP)


def volume_trend(rows: Column, average_rows: Column) -> Column:
    change = rows - average_rows
    return F.when(F.abs(change) < average_rows * STABLE_VOLUME, "stable").when(change > 0, "up").otherwise("down")


def stability(success_rate: Column) -> Column:
    return (
        F.when(success_rate >= VERY_STABLE_RATE, VERY_STABLE)
        .when(success_rate >= STABLE_RATE, FAIRLY_STABLE)
        .otherwise(UNSTABLE)
    )


def duration_remark(duration_deviation: Column) -> Column:
    slower, faster = duration_deviation > SLOWER_DURATION, duration_deviation < FASTER_DURATION
    return F.when(slower, "slower").when(faster, "faster").otherwise("expected")


def growth_alert(rows_deviation: Column) -> Column:
    return rows_deviation > GROWTH_ROWS
