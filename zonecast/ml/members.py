"""Model members (M1-M3) and their common inputs.

The reference blends three gradient-boosting libraries.  Here the members are boosted trees of depth 7 and step 0.05,
grown together on the cluster (``ml.boosting``), each in its library's manner:
  cat - depth-wise on all rows and features
  lgb - best-first up to 63 leaves, 80 % of rows and features a tree, 20 rows a leaf at least
  xgb - depth-wise, 80 % of rows and features a tree, leaves shrunk by one row
Categories are binned by value in code-point order (unseen values have a bin of their own); one with more values than
there are bins goes by a hash of its values, so their number has no bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.ml.boosting import Spec, best_rounds  # noqa: F401  (part of this module's interface)
from zonecast.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

MEMBERS = ("cat", "lgb", "xgb")
SEED = 42


@dataclass
class MemberConfig:
    rounds: int = 1000        # boosting rounds / trees (reference: 1000 CV, 1200 final)
    patience: int | None = 50  # early-stopping patience on the validation fold
    max_depth: int = 7
    step: float = 0.05

    def specs(self) -> list[Spec]:
        common = dict(max_depth=self.max_depth, step=self.step)
        return [Spec(smoothing=3.0, **common), Spec(leaves=63, rows=0.8, features=0.8, smoothing=0.0, min_rows=20, **common),
                Spec(rows=0.8, features=0.8, **common)]


def model_frame(df: DataFrame, label: str | None = "demand",
                extra: list[str] | None = None) -> DataFrame:
    """Numeric features with NULL -> 0 in a fixed order (absent -> 0),
    categoricals as text with NULL -> 'nan', plus the id and label."""
    keep = ["row_id"] + ([label] if label and label in df.columns else []) + (extra or [])
    num = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
           else F.lit(0.0).alias(c) for c in NUMERIC_FEATURES]
    cat = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)
           for c in CATEGORICAL_FEATURES]
    return df.select(*keep, *num, *cat)


def feature_names() -> list[str]:
    return NUMERIC_FEATURES + CATEGORICAL_FEATURES
