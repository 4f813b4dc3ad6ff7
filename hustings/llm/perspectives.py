"""Multi-party dialogues, rendered once from the view of every participant. DataFrame functions only.

A rendering is kept as one row per message with its place in the whole text, so that a dialogue of any length is spread
over tasks; ``assembled`` joins the pieces of dialogues that fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_before

#: Message layout (fixed values).
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Speakers that only set the scene: they keep their own role in every view and have no view of their own.
NARRATORS = ("system",)
#: Turns of a dialogue that one task numbers.
TURNS_PER_BUCKET = 256


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """One row per participant and message: conv_id, viewpoint, turn, seq, role, name, piece, trained, begin, end,
    mask_begin, mask_end.

    Input: conv_id, turn, role (the speaker), text. For each speaker of a dialogue who is not a narrator, all its messages
    are rendered with that speaker as ``assistant``, narrators as themselves, and everyone else as a ``user`` with
    ``name``. ``begin`` and ``end`` are character offsets in the whole rendering, ``mask_begin`` and ``mask_end`` those
    of the words to train on: the text and end mark of the viewpoint's own messages (null elsewhere).

    A null text is an empty message; a null or blank role is the speaker ``unknown``; a null conv_id is a dialogue.
    Messages are in the order of turn (null first), then of a hash of speaker and text; repeated rows are each rendered.
    A dialogue of narrators only gives no rows, like an empty table. Other columns are ignored.
    """
    speaker = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown"))
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_narrator = F.col("speaker").isin(*narrators)
    said = said.withColumn("tie", F.md5(F.concat_ws("\x1f", "speaker", "text").cast("binary")))
    said = said.withColumn("bucket", F.floor(F.col("turn") / TURNS_PER_BUCKET)).withColumn("one", F.lit(1).cast("long"))
    views = said.where(~is_narrator).select(F.col("conv_id").alias("__c"), F.col("speaker").alias("viewpoint")).distinct()
    seen = said.join(views, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    own = F.col("speaker") == F.col("viewpoint")
    seen = seen.withColumn("role", F.when(own, "assistant").when(is_narrator, F.col("speaker")).otherwise("user"))
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit(MIDDLE))
    seen = seen.withColumn("head", head).withColumn("piece", F.concat("head", "text", F.lit(CLOSE)))
    seen = seen.withColumn("length", F.length("piece").cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("tie")]
    placed = running_before(seen, ["conv_id", "viewpoint"], "bucket", order, "length", "begin")
    placed = running_before(placed, ["conv_id", "viewpoint"], "bucket", order, "one", "seq")
    end = F.col("begin") + F.col("length")
    return placed.select(
        "conv_id", "viewpoint", "turn", "seq", "role", "name", "piece", own.alias("trained"), "begin", end.alias("end"),
        F.when(own, F.col("begin") + F.length("head")).alias("mask_begin"), F.when(own, end - 1).alias("mask_end"),
    )


def assembled(pieces: DataFrame, most_chars: int = 1_000_000) -> DataFrame:
    """(conv_id, viewpoint, rendered, spans) of the renderings up to ``most_chars`` long; the longer ones stay in pieces."""
    size = Window.partitionBy("conv_id", "viewpoint")
    fits = pieces.withColumn("total", F.max("end").over(size)).where(F.col("total") <= most_chars)
    rows = F.sort_array(F.collect_list(F.struct("begin", "piece", "mask_begin", "mask_end")))
    return fits.groupBy("conv_id", "viewpoint").agg(rows.alias("rows")).select(
        "conv_id", "viewpoint", F.array_join(F.col("rows.piece"), "").alias("rendered"),
        F.transform(F.filter("rows", lambda r: r["mask_begin"].isNotNull()), lambda r: F.struct(r["mask_begin"].alias("begin"), r["mask_end"].alias("end"))).alias("spans"),
    )
