"""The stateless stages on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import phrases


def clean_stream(events: DataFrame, text: str, listed: Sequence[str] = C.PHRASES) -> DataFrame:
    """Folded text without phrases; works on a stream as on a table."""
    return events.withColumn(text, phrases.remove_phrases(X.fold_ascii(F.col(text)), listed))
