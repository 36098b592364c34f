"""Planned samples to padded rows.

Padding and the image gate need only lengths and flags of a batch. Those are found on narrow rows; the text
itself is joined to its finished place by key, tokenised and padded there, and so crosses the network once.
The 2098 constants of the image template are added after that last exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions import tokens as T
from pixelquilt.operators import batching as B
from pixelquilt.operators.ordinals import keyed


def encode_text_batches(
    samples: DataFrame,
    plan: DataFrame,
    key: str,
    text: str,
    max_length: int,
    batch: list[str] = B.BATCH,
    arrange: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Text-only training rows: ids, mask and labels of one length per batch.

    ``arrange`` moves the texts and their places to where they are written, before they become arrays.
    """
    lengths = samples.select(key, T.text_length(F.col(text), max_length).alias("_n"))
    placed = B.with_batch_max(plan.join(lengths, key), {"_ids_len": F.col("_n")}, batch).drop("_n")
    rows = keyed(placed, key).join(samples.select(key, text), key)
    rows = arrange(rows) if arrange else rows
    encoded = rows.withColumn("input_ids", T.encode_text(F.col(text), max_length)).drop(text)
    return _finish(_pad_to(encoded, "_ids_len"))


def encode_training_batches(
    samples: DataFrame,
    plan: DataFrame,
    key: str,
    prompt: str,
    usable: Column,
    max_length: int,
    batch: list[str] = B.BATCH,
    arrange: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Training rows of batches that may carry images. ``arrange`` as in ``encode_text_batches``.

    A batch keeps its images only if every row has one: then ids are the image template and the clipped text,
    with a patch index of its own length. Otherwise the whole batch is text only and the patch index is null.
    """
    facts = samples.select(
        key,
        usable.alias("_usable"),
        T.text_length(F.col(prompt), max_length).alias("_n_text"),
        T.clipped_length(F.col(prompt), max_length).alias("_n_clip"),
    )
    window = Window.partitionBy(*batch)
    placed = plan.join(facts, key).select(
        *plan.columns,
        F.min("_usable").over(window).alias("has_images"),
        F.max("_n_text").over(window).alias("_text_len"),
        (F.max("_n_clip").over(window) + T.TEMPLATE_LENGTH).alias("_image_len"),
    )
    placed = placed.withColumn("_ids_len", F.when(F.col("has_images"), F.col("_image_len")).otherwise(F.col("_text_len")))
    rows = keyed(placed, key).join(samples.select(key, prompt), key)
    rows = arrange(rows) if arrange else rows
    text = F.col(prompt)
    encoded = rows.withColumn(
        "_text_ids",
        F.when(F.col("has_images"), T.tokenize_clipped(text, max_length)).otherwise(
            T.encode_text(text, max_length)
        ),
    ).drop(prompt)
    encoded = encoded.withColumn(
        "input_ids",
        F.when(F.col("has_images"), F.concat(T.template_ids(), F.col("_text_ids"))).otherwise(F.col("_text_ids")),
    )
    patches = T.pad_right(T.template_patches(), T.reserved_length(F.col("_image_len")), C.NO_PATCH)
    encoded = encoded.withColumn("image_patches_indices", F.when(F.col("has_images"), patches))
    return _finish(_pad_to(encoded, "_ids_len")).drop("_text_ids", "_text_len", "_image_len")


def encode_serving_batches(
    questions: DataFrame, plan: DataFrame, key: str, prompt: str, max_length: int, batch: list[str] = B.BATCH
) -> DataFrame:
    """Left-padded image rows for generation, with the closing id trimmed off."""
    lengths = questions.select(key, T.clipped_length(F.col(prompt), max_length).alias("_n"))
    placed = B.with_batch_max(
        plan.join(lengths, key), {"_ids_len": F.col("_n") + T.TEMPLATE_LENGTH}, batch
    )
    rows = keyed(placed, key).join(questions.select(key, prompt), key)
    clipped = rows.withColumn("_text_ids", T.tokenize_clipped(F.col(prompt), max_length))
    encoded = clipped.withColumn("input_ids", F.concat(T.template_ids(), F.col("_text_ids")))
    own = T.image_patch_indices(F.size("input_ids"))
    encoded = encoded.withColumn("image_patches_indices", T.pad_left(own, T.reserved_length(F.col("_ids_len")), C.NO_PATCH))
    return B.generation_trim(_pad_to(encoded, "_ids_len", left=True)).drop(prompt, "_text_ids", "_n", "_ids_len")


def _pad_to(df: DataFrame, length: str, left: bool = False) -> DataFrame:
    pad = T.pad_left if left else T.pad_right
    masked = df.withColumn("attention_mask", pad(T.ones(F.col("input_ids")), F.col(length), 0))
    return masked.withColumn("input_ids", pad(F.col("input_ids"), F.col(length), C.PAD_ID))


def _finish(padded: DataFrame) -> DataFrame:
    """Labels come after padding, so padding is part of them."""
    return B.replace_last_bos(B.with_labels(padded)).drop("_ids_len")
