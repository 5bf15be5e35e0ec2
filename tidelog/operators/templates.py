"""Message templates: masked tokens, clustered in order of first appearance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SLOT, masked, params, tokens
from .ordered import positions


def clusters(shapes: DataFrame) -> DataFrame:
    """(masked, template, born, then, shape_seq, first_seq) from distinct (masked, first_seq): the cluster's tokens at the
    end, of its first shape, and once this shape had joined; where the shape and the cluster first occur.

    Shapes of one length are independent of all others, so each length is one group, with
    its distinct shapes only. In order of first_seq a shape joins the first cluster in which
    under half of the tokens differ, and those become slots of the cluster; it is compared with all
    of them at once.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first_seq")
        width = len(rows["masked"].iloc[0])
        ids: dict[str, int] = {SLOT: 0}
        coded = np.array([[ids.setdefault(t, len(ids)) for t in shape] for shape in rows["masked"]], np.int64).reshape(len(rows), width)
        found, seqs, member, then = np.zeros((16, width), np.int64), [], [], []
        for seq, shape in zip(rows["first_seq"], coded, strict=True):
            n = len(seqs)
            differ = (found[:n] != shape).sum(axis=1)
            near = np.flatnonzero((2 * differ < width) | (width == 0))
            k = int(near[0]) if len(near) else n
            if k == n:
                if n == len(found):
                    found = np.concatenate([found, np.zeros_like(found)])
                found[n] = shape
                seqs.append(seq)
            else:
                found[k, found[k] != shape] = 0
            member.append(k)
            then.append(found[k].copy())
        words, listed, born = list(ids), list(rows["masked"]), {}
        for k, shape in zip(member, listed, strict=True):
            born.setdefault(k, shape)
        texts = lambda coded: [words[i] for i in coded]
        ends = [texts(found[k]) for k in range(len(seqs))]
        return pd.DataFrame({"masked": listed, "template": [ends[k] for k in member], "born": [born[k] for k in member], "then": [texts(t) for t in then], "shape_seq": rows["first_seq"], "first_seq": [seqs[k] for k in member]})

    kind = "masked array<string>, template array<string>, born array<string>, then array<string>, shape_seq long, first_seq long"
    return shapes.groupBy(F.size("masked")).applyInPandas(assign, kind)


def template_versions(found: DataFrame) -> DataFrame:
    """(first_seq, versions) of clusters: their texts with the `seq` from which each holds, in order.

    A cluster only ever widens, so it has one text more than it has tokens at most; shapes that change
    nothing are dropped before they meet.
    """
    texts = found.groupBy("first_seq", F.array_join("then", " ").alias("text")).agg(F.min("shape_seq").alias("seq"))
    return texts.groupBy("first_seq").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("versions"))


def template_events(events: DataFrame) -> DataFrame:
    """`events` (seq, message, ...) with template_id, template_text, template_key, text_then and params.

    Ids count from 1 by first appearance. Texts are those after all merges; `text_then` is the text as of the event: of
    the template's versions the last that begins up to it, found in a list of bounded length and not by a window over
    events. `template_key` is the text that the template began with, which stays as it widens.
    """
    raw = events.withColumn("_tokens", tokens(F.col("message"))).withColumn("_masked", masked(F.col("_tokens")))
    shapes = raw.groupBy(F.col("_masked").alias("masked")).agg(F.min("seq").alias("first_seq"))
    found = clusters(shapes)
    ids = positions(found.select("first_seq").distinct(), ["first_seq"], "template_id").withColumn("template_id", F.col("template_id").cast("long"))
    named = found.join(ids, "first_seq").join(template_versions(found), "first_seq").select(F.col("masked").alias("_masked"), "template", F.array_join("born", " ").alias("template_key"), "versions", "template_id")
    so_far = F.filter("versions", lambda v: v["seq"] <= F.col("seq"))
    return (
        raw.join(named, "_masked")
        .withColumns({"template_text": F.array_join("template", " "), "text_then": F.element_at(so_far, -1)["text"], "params": params(F.col("_tokens"), F.col("template"))})
        .drop("_masked", "_tokens", "template", "versions")
    )


def template_table(events: DataFrame, samples: int = 3) -> DataFrame:
    """Each template's count, first and last time, and its first few messages.

    Messages are numbered within ranges of (template, seq), so a frequent template is not one task's work.
    """
    placed = positions(events.select("template_id", "seq", "message"), ["seq"], "_n", by="template_id").filter(F.col("_n") <= samples)
    few = placed.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("sample_values"))
    per = events.groupBy("template_id", "template_text").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return per.join(few, "template_id")


def retained(table: DataFrame, most: int = 5000) -> DataFrame:
    """The templates that a bounded store holds at the end: those seen last, then the more frequent, then the newer ones."""
    return table.orderBy(F.desc("last_seen"), F.desc("count"), F.desc("template_id")).limit(most)


def rendered(template: Column, params: Column) -> Column:
    """A template's tokens in a line, its slots as `{value}`, or `{*}` where values run out."""
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        slot = token == SLOT
        shown = F.when(slot, F.concat(F.lit("{"), F.coalesce(F.get(params, s["used"]), F.lit("*")), F.lit("}"))).otherwise(token)
        return F.struct((s["used"] + slot.cast("int")).alias("used"), F.concat(s["out"], F.array(shown)).alias("out"))

    return F.aggregate(template, state, step, lambda s: F.array_join(s["out"], " "))
