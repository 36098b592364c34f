"""Steps over one logical batch. A batch has a fixed number of rows, so its window is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions import tokens as T

BATCH = ["epoch", "rank", "batch_id"]


def batch_image_gate(df: DataFrame, usable: Column, keys: list[str] = BATCH, out: str = "batch_has_images") -> DataFrame:
    """False for the whole batch as soon as one of its rows has no image."""
    return df.withColumn("_usable", usable).withColumn(
        out, F.min("_usable").over(Window.partitionBy(*keys))
    ).drop("_usable")


def batch_max_len(df: DataFrame, length: Column, keys: list[str] = BATCH, out: str = "batch_len") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(length).alias(out))


def with_batch_max(df: DataFrame, lengths: dict[str, Column], keys: list[str] = BATCH) -> DataFrame:
    """Attach batch maxima to every row; all of them share one exchange."""
    window = Window.partitionBy(*keys)
    return df.withColumns({name: F.max(length).over(window) for name, length in lengths.items()})


def _pad_batch(df: DataFrame, keys: list[str], ids: str, patches: str | None, left: bool, pad_id: int, ids_len: str | None, patch_len: str | None) -> DataFrame:
    pad = T.pad_left if left else T.pad_right
    lengths = {} if ids_len else {"_ids_len": F.size(ids)}
    if patches and not patch_len:
        lengths["_patch_len"] = F.size(patches)
    sized = with_batch_max(df, lengths, keys) if lengths else df
    ids_to, patches_to = F.col(ids_len or "_ids_len"), F.col(patch_len or "_patch_len")
    # The mask is made from the unpadded ids, so it comes first.
    padded = sized.withColumn("attention_mask", pad(T.ones(F.col(ids)), ids_to, 0))
    padded = padded.withColumn(ids, pad(F.col(ids), ids_to, pad_id))
    if patches:
        padded = padded.withColumn(patches, pad(F.col(patches), patches_to, C.NO_PATCH))
    return padded.drop(*lengths)


def pad_right(
    df: DataFrame,
    keys: list[str] = BATCH,
    ids: str = "input_ids",
    patches: str | None = None,
    pad_id: int = C.PAD_ID,
    ids_len: str | None = None,
    patch_len: str | None = None,
) -> DataFrame:
    """Pad ids and mask to the longest ids of the batch, the patch index to its own longest.

    ``ids_len`` and ``patch_len`` name columns with these lengths where they are known, as ``with_batch_max`` finds
    them on narrow rows. Then nothing is moved; otherwise the rows with their arrays meet by batch.
    """
    return _pad_batch(df, keys, ids, patches, False, pad_id, ids_len, patch_len)


def pad_left(
    df: DataFrame,
    keys: list[str] = BATCH,
    ids: str = "input_ids",
    patches: str | None = None,
    pad_id: int = C.PAD_ID,
    ids_len: str | None = None,
    patch_len: str | None = None,
) -> DataFrame:
    """The same with the padding in front, for generation."""
    return _pad_batch(df, keys, ids, patches, True, pad_id, ids_len, patch_len)


def generation_trim(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop the last element of ids, patch index and mask after left padding."""
    columns = columns or ["input_ids", "image_patches_indices", "attention_mask"]
    return df.withColumns({c: T.drop_last(F.col(c)) for c in columns if c in df.columns})


def with_labels(df: DataFrame, ids: str = "input_ids", out: str = "labels") -> DataFrame:
    return df.withColumn(out, T.label_mask(F.col(ids)))


def replace_last_bos(
    df: DataFrame, ids: str = "input_ids", labels: str = "labels", bos: int = C.BOS_ID, eos: int = C.EOS_ID
) -> DataFrame:
    """Where BOS occurs more than once the last one becomes EOS, in ids and labels. Run after ``with_labels``."""
    found = df.withColumn("_at", T.repeated_bos_index(F.col(ids), bos))
    return found.withColumns({c: T.put_at(F.col(c), F.col("_at"), eos) for c in (ids, labels)}).drop("_at")


def drop_token(
    df: DataFrame,
    token: int,
    keys: list[str] = BATCH,
    ids: str = "input_ids",
    labels: str = "labels",
    mask: str = "attention_mask",
    pad_id: int = C.PAD_ID,
    kept_len: str | None = None,
) -> DataFrame:
    """Remove one id everywhere, then pad the three arrays of the batch to their new longest.

    ``kept_len`` names a column with that length where it is known; then nothing is moved.
    """
    names = (ids, labels, mask)
    zipped = F.filter(F.arrays_zip(*names), lambda z: z[ids] != token)
    # The three arrays are read off in a step of their own: each depends on the ids as they were.
    removed = df.withColumn("_kept", zipped).withColumns({c: F.col(f"_kept.{c}") for c in names}).drop("_kept")
    sized = removed if kept_len else with_batch_max(removed, {"_len": F.size(ids)}, keys)
    fills = {ids: pad_id, labels: C.IGNORED_LABEL, mask: 0}
    return sized.withColumns({c: T.pad_right(F.col(c), F.col(kept_len or "_len"), v) for c, v in fills.items()}).drop("_len")


def pair_inputs(prompts: DataFrame, images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Prompts and images of a batch by position; the longer side's extra elements fall away."""
    return prompts.join(images, keys or ["batch_id", "pos"], "inner")


def image_only_prompts(images: DataFrame, keys: list[str] | None = None, prompt: str = "prompt") -> DataFrame:
    """Images without any text pair with a single empty prompt, that is, with position 0 only."""
    keys = keys or ["batch_id", "pos"]
    return images.filter(F.col(keys[-1]) == 0).withColumn(prompt, F.lit(""))
