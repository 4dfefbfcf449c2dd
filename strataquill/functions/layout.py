"""Column expressions on boxes x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common part of two intervals as a share of the shorter one; 0 if that has no length."""
    common = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(common, F.least(a1 - a0, b1 - b0)), F.lit(0.0))


#: Beginnings of numbered headings, in any case (fixed values).
NUMBERING = r"(?i)^(\d+\.?\s+|\d+\.\d+\.?\s+|\d+\.\d+\.\d+\.?\s+|[IVXLCDM]+\.?\s+|[A-Z]\.?\s+|Chapter\s+\d+|Section\s+\d+|Part\s+\d+|Appendix\s+[A-Z])"
#: Weights of the signs of a heading and the least sum (fixed values).
HEADING_WEIGHTS = {"font": 3.0, "bold": 2.0, "position": 1.5, "length": 1.0, "caps": 1.0, "isolation": 2.0, "numbering": 2.5}
HEADING_THRESHOLD = 5.0


def heading_score(text: Column, size: Column, median: Column, bold: Column, top_share: Column) -> Column:
    """The weighted sum of the signs that a block is a heading; isolation always counts."""
    t = F.trim(text)
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(parts, lambda w: F.left(w, F.lit(1)).rlike(r"\p{Lu}")))
    caps = ((t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 3)) | ((F.size(parts) > 0) & (capital / F.greatest(F.size(parts), F.lit(1)) >= 0.6))
    signs = {"font": size > median * 1.2, "bold": bold, "position": top_share > 0.33, "length": F.length(t) < 100, "caps": caps, "isolation": F.lit(True), "numbering": t.rlike(NUMBERING)}
    return sum((F.when(F.coalesce(v, F.lit(False)), F.lit(HEADING_WEIGHTS[k])).otherwise(0.0) for k, v in signs.items()), F.lit(0.0))
