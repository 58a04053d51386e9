"""Jobs over item contents: hashes, level checks, normalisation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def content_hash(df: DataFrame, key: str, content: str) -> DataFrame:
    """sha256, md5 and size of text or binary contents."""
    return df.select(key, F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.octet_length(content).cast("long").alias("bytes"))


def level_stats(samples: Column, frames: Column, rate: Column) -> dict[str, Column]:
    """Length in seconds and levels of samples in [-1, 1), as array expressions; no samples give no levels."""
    n = F.nullif(F.size(samples), F.lit(0))
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return {
        "duration": frames / F.nullif(rate, F.lit(0)),
        "rms": F.when(n.isNotNull(), F.log10(F.greatest(F.sqrt(squares / n), F.lit(1e-12))) * 20.0),
        "peak": F.array_max(F.transform(samples, F.abs)),
        "clipping": F.size(F.filter(samples, lambda x: F.abs(x) >= 0.999)) / n,
    }


def normalise_plan(df: DataFrame, rate: Column, channels: Column, rms_db: Column, peak: Column, target_rate: int = 16_000, target_rms: float = 0.1) -> DataFrame:
    """Which items need resampling, downmixing or gain; the gain is the level ratio."""
    level = F.pow(F.lit(10.0), rms_db / 20.0)
    gain = F.when(level > 0, F.lit(target_rms) / level).otherwise(F.lit(1.0))
    return df.withColumns(
        {
            "resample": F.coalesce(rate != target_rate, F.lit(False)),
            "downmix": F.coalesce(channels > 1, F.lit(False)),
            "gain": gain,
            "clips_after_gain": F.coalesce(peak * gain > 1.0, F.lit(False)),
        }
    )
