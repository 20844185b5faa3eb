"""Table -> cleaned, split, encoded, scaled training data -> sharded Parquet.

The reference's preparation issues about 53 Spark actions, each recomputing
from the source view (23 indexer fits, 22 distinct counts, 3 counts, ...), and
sorts the whole table in one task twice (episode windows and percent_rank).
This plan keeps its semantics with four passes over the input:

1. a (time, label) histogram: cut values of the time split and the split x
   label counts
2. value counts of all categorical columns: every indexer and every
   cardinality
3. the scaler fit on the training rows
4. one write of all splits (``partitionBy("split")``), or three writes

The input is not cached by default: every job reads only the columns it
needs (column pruning), which is cheaper than storing a copy for a table;
``persist_input=True`` keeps a costly view (a large join) between the jobs. Column names are arguments (:class:`PrepSpec`), nothing is specific
to one dataset.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, encode, episodes, scale, split
from ..operators.balance import class_weights
from ..session import reliable_checkpoint, reuse
from ..sources.parquet import write_shards


@dataclass
class PrepSpec:
    label: str
    time: str
    string_categories: list
    int_categories: list
    continuous: list
    entity_parts: list | None = None      # parts of the derived entity key
    entity: str | None = None             # name of the derived entity key
    threshold_col: str | None = None      # keep threshold_col >= threshold
    threshold: float | None = None
    required: list = field(default_factory=list)  # NULL / NaN here drops the row
    episodes: bool = False                # add case_id, time, time2, time3
    tiebreak: str | None = None           # unique column ordering tied rows for lag
    bounds: tuple = (0.8, 0.9)
    fit_index_on: str = "all"             # "all" (as the reference) or "train"
    handle_invalid: str = "error"
    features_col: str = "scaledFeatures"
    limit: int | None = None              # at most so many input rows (trial exports), any
                                          # of them, but the same in every pass

    @property
    def categories(self) -> list:
        return list(self.string_categories) + list(self.int_categories)


@dataclass
class Prepared:
    frame: DataFrame            # all rows, with a ``split`` column
    hi: object                  # last training time
    lo: object                  # first test time
    index_model: object
    scaler_model: object
    spec: PrepSpec
    label_counts: DataFrame | None = None   # (split, label, n)
    cardinality: DataFrame | None = None    # (column, cardinality), from the index pass
    labelled: DataFrame | None = None       # cleaned input with ``split``, before transforms

    def transform(self, labelled: DataFrame) -> DataFrame:
        """Apply the fitted index and scaler to rows that carry a ``split`` column."""
        spec = self.spec
        indexed = self.index_model.transform(labelled).drop(*spec.categories)
        final = scale.apply_scaler(self.scaler_model, indexed, spec.continuous, spec.features_col)
        extra = ["case_id", "time", "time2", "time3"] if spec.episodes else []
        keep = ([spec.label] + [c + "_cat" for c in spec.categories] + extra
                + [spec.features_col, "split"])
        return final.select(*keep)

    def split(self, name: str) -> DataFrame:
        return self.frame.where(F.col("split") == name).drop("split")

    @property
    def cat_index_cols(self) -> list:
        return [c + "_cat" for c in self.spec.categories]


def clean_frame(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Row limit (checkpointed, so all passes see the same rows), filter, entity key, optional
    episodes, NULL drop; lazy but for the limit and the episodes."""
    if spec.limit is not None:
        df = reliable_checkpoint(df.limit(spec.limit))
    if spec.threshold_col is not None:
        df = clean.filter_threshold(df, spec.threshold_col, spec.threshold)
    if spec.entity_parts:
        df = clean.with_entity_key(df, spec.entity_parts, spec.entity)
    if spec.episodes:
        df = episodes.assign_episodes(df, spec.entity, spec.time, spec.label, spec.tiebreak)
        df = episodes.time_polynomial(df)
    if spec.required:
        df = clean.drop_required_nulls(df, spec.required)
    return df


def prepare(df: DataFrame, spec: PrepSpec, persist_input: bool = False) -> Prepared:
    """Clean, split by time, fit indexers and scaler; return the lazy result.

    Each pass over the cleaned input before the write reads only its own
    columns: the time column -> cuts; value counts -> index and cardinalities;
    train moments -> scaler; (time, label) -> split x label counts, when they
    are asked for. ``persist_input=True`` keeps the input between them when it
    is costly to recompute (a large join or window upstream), see
    :func:`chronofeat.session.reuse`.
    """
    df = clean_frame(df, spec)
    df = reuse(df) if persist_input else df
    hi, lo, _ = split.time_cuts(df, spec.time, spec.bounds)
    label_counts = split.label_counts_for_cuts(df, spec.time, spec.label, hi, lo)
    labelled = split.split_column(df, spec.time, hi, lo)
    if spec.fit_index_on == "all":
        index_model, card = encode.index_and_cardinality(
            labelled, spec.categories, "_cat", spec.handle_invalid)
    else:
        index_model = encode.fit_category_index(labelled.where(F.col("split") == "train"),
                                                spec.categories, "_cat", "keep")
        card = encode.cardinality(df, spec.categories)
    # only "skip" drops rows; otherwise the moments need no index joins
    kept = index_model.transform(labelled) if index_model.handle_invalid == "skip" else labelled
    train = kept.where(F.col("split") == "train")
    scaler_model = scale.fit_scaler(train, spec.continuous, spec.features_col)
    prepared = Prepared(None, hi, lo, index_model, scaler_model, spec,
                        label_counts, encode.embedding_width(card), labelled)
    prepared.frame = prepared.transform(labelled)
    return prepared


def summaries(prepared: Prepared, cleaned: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cardinalities / embedding widths, split x label counts and class weights.

    All three come from tables the preparation already built (no new pass
    over the data); ``cleaned`` is only read if those are missing.
    """
    spec = prepared.spec
    card = prepared.cardinality
    if card is None:
        card = encode.embedding_width(encode.cardinality(cleaned, spec.categories))
    counts = prepared.label_counts
    if counts is None:
        counts = split.label_counts_for_cuts(cleaned, spec.time, spec.label,
                                             prepared.hi, prepared.lo)
    weights = class_weights(counts.where(F.col("split") == "train"), spec.label, count_col="n")
    return {"cardinality": card, "split_label_counts": counts, "class_weights": weights}


def export(prepared: Prepared, path: str, num_files: int | None = None,
           one_job: bool = True, block_size: int | None = None) -> str:
    """Write the splits as Parquet (``path/split=<name>/`` or three folders).

    The row-wise index and scale transforms run in the tasks that read the
    rows; ``num_files=n`` adds one exchange after them, for readers that need an
    exact number of files. ``block_size`` sets the row groups' size in bytes.
    """
    frame, spread = prepared.frame, num_files
    if one_job:
        return write_shards(frame, path, num_files=spread, block_size=block_size,
                            partition_by="split")
    for name in ("train", "val", "test"):
        part = frame.where(F.col("split") == name).drop("split")
        write_shards(part, f"{path}/{name}", num_files=spread, block_size=block_size)
    return path
