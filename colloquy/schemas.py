"""Explicit schemas for every table the package reads (no inference)."""

from pyspark.sql import types as T

# Patient profile: key order of ``simple_info`` is kept by a MAP schema;
# list values stay as JSON text ('["a","b"]') and are rendered by
# ``functions.text.render_profile``.
PROFILE = T.StructType([
    T.StructField("pid", T.StringType()),
    T.StructField("disease_name", T.StringType()),
    T.StructField("simple_info", T.MapType(T.StringType(), T.StringType())),
])

# Dialogue as written by the simulator (legacy CSV): QA is a list literal.
DIALOGUE_CSV = T.StructType([
    T.StructField("pid", T.StringType()),
    T.StructField("disease", T.StringType()),
    T.StructField("QA", T.StringType()),
])

# Dialogue after the organizer (legacy CSV).
ORGANIZED_CSV = T.StructType(DIALOGUE_CSV.fields + [T.StructField("organized_QA", T.StringType())])

# Dialogue after the comparer (legacy CSV).
SCORED_CSV = T.StructType(ORGANIZED_CSV.fields + [
    T.StructField("referred_gold_label", T.StringType()),
    T.StructField("reasons", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("weighted_score", T.LongType()),
    T.StructField("penalty_score", T.DoubleType()),
    T.StructField("reward_score", T.DoubleType()),
])

# Dialogue after diagnosis (legacy CSV).  Booleans are read as text so a
# YAML answer such as ``True/False`` is not silently turned into NULL.
DIAGNOSED_CSV = T.StructType(SCORED_CSV.fields + [
    T.StructField("model_predictions", T.StringType()),
    T.StructField("topk_reason", T.StringType()),
    T.StructField("topk_result", T.StringType()),
    T.StructField("top1_reason", T.StringType()),
    T.StructField("top1_result", T.StringType()),
])

# Gold labels (CSV columns in file order); ``ord`` is added at ingest.
GOLD_CSV = T.StructType([
    T.StructField("disease", T.StringType()),
    T.StructField("weight", T.StringType()),
    T.StructField("symptom", T.StringType()),
])

GOLD = T.StructType([
    T.StructField("disease", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("symptom", T.StringType()),
    T.StructField("weight", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

# Output of the model-call operator (U1 / U2).
MODEL_RESULT = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
])
