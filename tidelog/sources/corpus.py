"""A log corpus with labelled anomalies, made from row numbers: any part can be made anywhere, twice the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of anomaly, one window each, by share of the time line.
KINDS = ("volume", "new_template", "stopped_template", "error_rate", "numeric_shift", "rare_sequence")


#: Messages of the verbs around a number. No two of one length share half of their words, so each is a template.
USUAL = {
    "depart": ("vessel ", " left its berth"),
    "anchor": ("dropped anchor in roads near buoy ", ""),
    "unload": ("crane lifts container ", " onto quay wall now"),
    "refill": ("pump filling tank ", ""),
    "inspect": ("hull survey ", " passed"),
}
#: These never follow one another, but in the anomaly of sequences.
APART = {
    "lower": ("chain one pays out slowly to link ", ""),
    "weigh": ("windlass turning at ", " revolutions"),
    "hoist": ("signal flags ", " flown from the mast"),
}
SCARCE = {"audit": ("ledger page ", " signed by harbour master office today also")}
NOVEL = {"capsize": ("mayday from tug ", " listing badly in fairway east")}
MESSAGES = USUAL | APART | SCARCE | NOVEL

#: Rows that stay in one source; every seventh row has a verb of APART.
BLOCK, EVERY = 49, 7


@dataclass(frozen=True)
class Corpus:
    lines: int = 1_000_000
    seed: int = 7
    start: float = 1_767_225_600.0
    hours: float = 72.0

    def window(self, kind: str) -> tuple[float, float]:
        """Half-open span of a kind: anomalies lie apart in the second half, 15 minutes each."""
        at = self.start + self.hours * 3600 * (0.51 + 0.07 * KINDS.index(kind))
        return at, at + 900.0


def labels(spark: SparkSession, c: Corpus) -> DataFrame:
    return spark.createDataFrame([(i, k, *c.window(k)) for i, k in enumerate(KINDS)], "label_id long, kind string, start double, end double")


def generate(spark: SparkSession, c: Corpus, partitions: int | None = None) -> DataFrame:
    """(source, seq, text): half JSON, a fifth logfmt, the rest access and syslog lines."""
    step = c.hours * 3600 / c.lines
    roll = lambda salt, by="seq": F.pmod(F.xxhash64(by, F.lit(c.seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
    within = lambda kind: (F.col("due") >= c.window(kind)[0]) & (F.col("due") < c.window(kind)[1])
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), F.floor(by * len(names)).cast("int") + 1)
    rows = spark.range(0, c.lines, 1, partitions).withColumnRenamed("id", "seq").withColumns({"due": F.lit(c.start) + F.col("seq") * step, "block": F.floor(F.col("seq") / BLOCK)})
    # Three rows in a quick sequence, of every twelve.
    quick = within("rare_sequence") & (F.floor(F.col("seq") / 3) % 4 == 0)
    verb = F.when(quick, pick(list(APART), (F.col("seq") % 3) / 3.0 + 0.01))
    verb = verb.when(within("volume") & (roll("flood") < 0.5), "audit").when(within("new_template") & (roll("new") < 0.3), "capsize")
    verb = verb.when(F.col("seq") % EVERY == 3, pick(list(APART), roll("apart"))).when(roll("scarce") < 0.006, "audit")
    usual = pick(list(USUAL), roll("verb"))
    usual = F.when(within("stopped_template") & (usual == "inspect"), "depart").otherwise(usual)
    service = pick(("ferry", "kiln", "orchard", "quarry"), roll("service", "block"))
    failing = roll("level") < F.when(within("error_rate"), 0.6).otherwise(0.01)
    millis = F.round((roll("millis") * 20 + 40) * F.when(within("numeric_shift"), 3.0).otherwise(1.0), 1)
    at = F.when(quick, F.lit(c.start) + F.floor(F.col("seq") / 3) * 3 * step + F.col("seq") % 3 * min(0.2, step)).otherwise(F.col("due"))
    full = rows.withColumns({
        "verb": verb.otherwise(usual), "service": F.when(quick, "ferry").otherwise(service), "level": F.when(failing, "error").otherwise("info"),
        "ms": millis, "form": F.when(quick, 0.0).otherwise(roll("form")), "at": at,
    })
    return full.select("service", "seq", _line().alias("text")).withColumnRenamed("service", "source")


def _line() -> Column:
    level, ms, seq, verb = F.col("level"), F.col("ms"), F.col("seq"), F.col("verb")
    when = F.timestamp_micros((F.col("at") * 1e6).cast("long"))
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    around = lambda i: F.element_at(F.create_map(*[F.lit(x) for v, m in MESSAGES.items() for x in (v, m[i])]), verb)
    message = F.concat(around(0), seq % 997, around(1))
    json = F.to_json(F.struct(stamp.alias("ts"), level.alias("level"), message.alias("msg"), ms.alias("duration_ms")))
    logfmt = F.concat(F.lit("ts="), stamp, F.lit(" level="), level, F.lit(' msg="'), message, F.lit('" duration_ms='), ms)
    status = F.when(level == "error", "503").otherwise("200")
    access = F.concat(F.lit("10.0.0."), seq % 250, F.lit(" - - ["), F.date_format(when, "dd/MMM/yyyy:HH:mm:ss '+0000'"), F.lit('] "GET /'), verb, F.lit(' HTTP/1.1" '), status, F.lit(" 512 \"-\" \"-\" "), F.format_string("%.4f", ms / 1000))
    syslog = F.concat(F.when(level == "error", "<27>1 ").otherwise("<30>1 "), stamp, F.lit(" dock "), F.col("service"), F.lit(" 77 - - "), message)
    return F.when(F.col("form") < 0.5, json).when(F.col("form") < 0.7, logfmt).when(F.col("form") < 0.85, access).otherwise(syslog)
