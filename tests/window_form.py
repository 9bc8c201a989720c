"""The scoring rule with a running trace text in a window: exact and plain,
but every statement of a dialogue passes one task.  It checks the package's
form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import scoring as S


def flags(bullets, gold, keys, mode):
    ann = S.annotate_bullets(bullets, gold)
    ordered = Window.partitionBy(*keys).orderBy("pos")
    j = ann.withColumn("brk", F.min(F.when(F.col("poison"), F.col("pos"))).over(Window.partitionBy(*keys)))
    j = j.withColumn("live", F.col("brk").isNull() | (F.col("pos") < F.col("brk")))
    if mode == S.EXACT:
        seen = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("pos")) > 1
    else:
        line = F.when(F.col("live"), F.concat(F.lit("- "), F.col("label"), F.lit("\n")))
        prior = F.array_join(F.collect_list(line).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), "")
        seen = F.coalesce(prior.contains(F.col("resp")), F.lit(False))
    return j.withColumn("seen", seen)


def score(bullets, gold, keys, mode=S.SUBSTRING, form="package"):
    if form == "package":
        return S.score_bullets(bullets, gold, keys, mode=mode)
    return S.score_flags(flags(bullets, gold, keys, mode), keys)
