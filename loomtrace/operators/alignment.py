"""Inputs of a calculation as of a time: the freshest accepted value of each of several signals, unless it is too old."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import scan
from loomtrace.plans.equations import usable


@dataclass(frozen=True)
class Input:
    """What an equation declares of an input: its name, the signal that feeds it, its greatest age and the qualities it accepts."""

    name: str
    signal: str
    maximum_age_ms: int
    accepted_quality: tuple[str, ...]


def aligned(requests: DataFrame, samples: DataFrame, key: str, time_us: str, inputs: list[Input], tie: str, signal: str = "signal_id", value: str = "value", quality: str = "quality", evidence: str = "evidence_ref") -> DataFrame:
    """requests with a struct (value, age_ms, quality, evidence_ref) for each input by its name, null where there is none.

    Of an input's samples at or before the request those of an accepted quality count, of these the last one,
    of equal times that of the greatest `tie`; it is null if it is older than the input allows. A null time
    or quality is never accepted, and requests without a time get no inputs.

    One union and one scan carry all inputs at once, however many: no join per input. Samples that no input
    accepts are left out before the shuffle. Keys with many rows are split by time (scan.carried).
    """
    columns = [c for c in requests.columns if c != time_us]
    row = F.struct(*columns)
    sample = F.struct(F.col(value).alias("value"), F.col(time_us).alias("at"), F.col(quality).alias("quality"), F.col(evidence).alias("evidence_ref"))
    fits = {i.name: (F.col(signal) == i.signal) & F.col(quality).isin(list(i.accepted_quality)) & F.col(time_us).isNotNull() for i in inputs}
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    fed = samples.select(key, time_us, F.lit(0).alias("__side"), F.col(tie).alias("__tie"), none(row, requests).alias("__row"), *(F.when(fits[i.name], sample).alias(f"__{i.name}") for i in inputs))
    fed = fed.where(" OR ".join(f"`__{i.name}` IS NOT NULL" for i in inputs))
    asked = requests.select(key, time_us, F.lit(1).alias("__side"), none(F.col(tie), samples).alias("__tie"), row.alias("__row"), *(none(sample, samples).alias(f"__{i.name}") for i in inputs))
    at = scan.carried(fed.unionByName(asked), [key], [time_us, "__side", "__tie"], {i.name: (scan.LAST, F.col(f"__{i.name}")) for i in inputs}).where("__side = 1")
    out = []
    for i in inputs:
        got = F.col(i.name)
        age = F.floor((F.col(time_us) - got["at"]) / 1000)
        fresh = usable(F.col(time_us) - got["at"], F.lit(i.maximum_age_ms).cast("long") * 1000, got["quality"], F.array(*map(F.lit, i.accepted_quality)))
        out.append(F.when(fresh, F.struct(got["value"].alias("value"), age.alias("age_ms"), got["quality"].alias("quality"), got["evidence_ref"].alias("evidence_ref"))).alias(i.name))
    return at.select(*(F.col(time_us) if c == time_us else F.col(f"__row.{c}") for c in requests.columns), *out)
