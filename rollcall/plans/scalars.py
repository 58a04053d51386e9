"""Queries for column functions on text, identifiers, numbers and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import hashing as H
from rollcall.functions import labels as L
from rollcall.functions import numbers as N
from rollcall.functions import quality as Q
from rollcall.functions import weights as Wt
from rollcall.operators.rules import last_wins
from rollcall.plans.registry import query
from rollcall.plans.tables import entities, items, load, with_sql


def by_mod(key, *options):
    """Pick one of the options by ``key % n``."""
    out = F.when(F.lit(False), options[0])
    for i, option in enumerate(options[:-1]):
        out = out.when(key % len(options) == i, option)
    return out.otherwise(options[-1])


def words(key, *options):
    return by_mod(key, *[F.lit(o).cast("string") for o in options])


def words_sql(key: str, *options) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {'NULL' if o is None else chr(39) + o + chr(39)}" for i, o in enumerate(options)
    )
    return f"CASE {key} % {len(options)} {cases} END"


@query(
    "scl_imperial_to_cm",
    """SELECT p_partkey, txt, CASE WHEN regexp_matches(txt, '^[0-9]') THEN
         round_even((split_part(replace(txt, '"', ''), '''', 1)::INT * 12
           + coalesce(TRY_CAST(split_part(replace(txt, '"', ''), '''', 2) AS INT), 0)) * 2.54::DOUBLE, 2) END AS cm
       FROM (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN (4 + p_size % 3)::VARCHAR
         ELSE concat(4 + p_size % 3, '''', p_partkey % 12, '"') END AS txt FROM part)""",
)
def imperial(spark: SparkSession, sf: str) -> DataFrame:
    feet, key = (F.lit(4) + F.col("p_size") % 3).cast("string"), F.col("p_partkey")
    full = F.concat(feet, F.lit("'"), (key % 12).cast("string"), F.lit('"'))
    text = F.when(key % 10 == 0, "n/a").when(key % 10 == 1, feet).otherwise(full)
    return load(spark, sf, "part").select("p_partkey", text.alias("txt")).withColumn("cm", N.imperial_to_cm(F.col("txt")))


@query(
    "scl_cm_to_feet_inches",
    with_sql("ent")
    + """SELECT entity_id, printf('%d''%.1f"', floor(y / 2.54::DOUBLE / 12)::BIGINT, (y / 2.54::DOUBLE) % 12.0::DOUBLE) AS txt FROM ent""",
)
def feet_inches(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).select("entity_id", N.cm_to_feet_inches(F.col("y")).alias("txt"))


@query(
    "scl_derive_age",
    """SELECT o_orderkey, floor(date_diff('day', b, r) / 365)::INT AS age FROM (
         SELECT o_orderkey, CASE WHEN year(r) > 2000 THEN (r - INTERVAL 100 YEAR)::DATE ELSE r END AS r,
                CASE WHEN year(b) > 2000 THEN (b - INTERVAL 100 YEAR)::DATE ELSE b END AS b FROM (
           SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%m/%d/%y'), '%m/%d/%y')::DATE AS r,
             try_strptime(CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate
               - to_days((365 * (5 + o_orderkey % 50) + o_orderkey % 300)::INT), '%m/%d/%y') END, '%m/%d/%y')::DATE AS b
           FROM orders))""",
)
def ages(spark: SparkSession, sf: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    birth = F.date_sub(day, (F.lit(365) * (F.lit(5) + key % 50) + key % 300).cast("int"))
    born = F.when(key % 50 == 0, "unknown").otherwise(F.date_format(birth, "MM/dd/yy"))
    return load(spark, sf, "orders").select(
        "o_orderkey", N.derive_age(F.date_format(day, "MM/dd/yy"), born).alias("age")
    )


_LABELS = ("Male", " m ", "F", "woman", "other", "?", "", None)


@query(
    "scl_normalize_label",
    f"""SELECT c_custkey, CASE WHEN w IN ('male','m') THEN 'Male' WHEN w IN ('female','f') THEN 'Female' ELSE 'Unknown' END AS plain,
         CASE WHEN w IN ('male','m','1','1.0') THEN 1 WHEN w IN ('female','f','0','0.0') THEN 0 END AS binary_label,
         CASE WHEN w IN ('m','male','man') THEN 'Male' WHEN w IN ('f','female','woman') THEN 'Female'
           WHEN w IN ('other','nonbinary','non-binary') THEN 'Other'
           WHEN w IN ('prefer not to say','prefer_not_to_say','unknown','') THEN 'Prefer not to say' ELSE trim(t) END AS intake,
         CASE WHEN starts_with(w, 'm') THEN 1 ELSE 0 END AS prefixed
       FROM (SELECT c_custkey, {words_sql('c_custkey', *_LABELS)} AS t, lower(trim(coalesce(t, ''))) AS w FROM customer)""",
)
def labels(spark: SparkSession, sf: str) -> DataFrame:
    text = words(F.col("c_custkey"), *_LABELS)
    return load(spark, sf, "customer").select(
        "c_custkey",
        L.plain_label(text).alias("plain"),
        L.binary_label(text).alias("binary_label"),
        L.intake_label(text).alias("intake"),
        L.prefix_label(text).alias("prefixed"),
    )


@query(
    "scl_safe_number",
    """SELECT o_orderkey, CASE WHEN isfinite(TRY_CAST(trim(t) AS DOUBLE)) THEN TRY_CAST(trim(t) AS DOUBLE) END AS strict_value,
         CASE WHEN isfinite(TRY_CAST(replace(trim(t), ',', '') AS DOUBLE)) THEN TRY_CAST(replace(trim(t), ',', '') AS DOUBLE) END AS loose_value
       FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN concat(' ', o_orderkey, ' ') WHEN 1 THEN concat(o_orderkey, ',000')
         WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN 'abc' WHEN 5 THEN concat('-', o_orderkey, '.5') ELSE '' END AS t FROM orders)""",
)
def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    txt = key.cast("string")
    text = by_mod(
        key, F.concat(F.lit(" "), txt, F.lit(" ")), F.concat(txt, F.lit(",000")), F.lit("nan"), F.lit("inf"),
        F.lit("abc"), F.concat(F.lit("-"), txt, F.lit(".5")), F.lit(""),
    )
    return load(spark, sf, "orders").select(
        "o_orderkey", N.safe_number(text).alias("strict_value"), N.safe_number(text, True).alias("loose_value")
    )


_YES = ("Yes", " TRUE ", "1", "no", "consented", None)


@query(
    "scl_is_yes",
    f"""SELECT o_orderkey, lower(trim(coalesce({words_sql('o_orderkey', *_YES)}, ''))) IN ('1','true','yes','y','consented') AS yes
        FROM orders""",
)
def yes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", L.is_yes(words(F.col("o_orderkey"), *_YES)).alias("yes"))


_LIST = "list_filter(list_transform(string_split(concat(p_brand, ' | ', p_type, '||', p_brand, '|', p_name), '|'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "scl_split_list",
    f"""SELECT p_partkey, len(l) AS n_all, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS uniq,
          array_to_string(l[1:2], '|') AS first_two FROM (SELECT p_partkey, {_LIST} AS l FROM part)""",
)
def lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" | "), "p_type", F.lit("||"), "p_brand", F.lit("|"), "p_name")
    return load(spark, sf, "part").select(
        "p_partkey",
        F.size(L.split_list(text)).cast("long").alias("n_all"),
        L.join_list(L.split_list(text, distinct=True)).alias("uniq"),
        L.join_list(L.split_list(text, first=2)).alias("first_two"),
    )


@query("scl_join_list", "SELECT p_partkey, array_to_string([p_name, p_brand, p_type], '|') AS joined FROM part")
def joined(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        "p_partkey", L.join_list(F.array("p_name", "p_brand", "p_type")).alias("joined")
    )


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Page urls as messy file paths: below the root, elsewhere, relative, backslashes."""
    key = F.col("page_id")
    tail = F.regexp_replace("url", "^https?://", "")
    path = by_mod(
        key, F.concat(F.lit("/data/"), tail), F.concat(F.lit("/other/"), tail), tail,
        F.replace(F.concat(F.lit("/data/"), tail), F.lit("/"), F.lit("\\")),
    )
    return load(spark, sf, "pages").select("page_id", path.alias("path"))


_PATHS = r"""paths AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/data/', t) WHEN 1 THEN concat('/other/', t) WHEN 2 THEN t
  ELSE replace(concat('/data/', t), '/', '\') END AS path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS t FROM pages))"""


@query(
    "scl_path_norm",
    rf"""WITH {_PATHS} SELECT page_id, list_last(string_split(p, '/')) AS base,
          CASE WHEN starts_with(p, '/data/') THEN substr(p, 7) WHEN starts_with(p, '/') THEN concat('_abs/', substr(p, 2)) ELSE p END AS rel
        FROM (SELECT page_id, replace(path, '\', '/') AS p FROM paths)""",
)
def paths(spark: SparkSession, sf: str) -> DataFrame:
    return page_paths(spark, sf).select(
        "page_id", L.basename(F.col("path")).alias("base"), L.relative_path(F.col("path"), "/data").alias("rel")
    )


@query(
    "scl_path_suffix_match",
    rf"""WITH {_PATHS}, pairs AS (SELECT page_id, path AS a, CASE page_id % 3 WHEN 0 THEN concat('/mnt/copy/', path)
            WHEN 1 THEN concat(path, '.bak') ELSE path END AS b FROM paths),
        parts AS (SELECT page_id, replace(a, '\', '/') AS a, replace(b, '\', '/') AS b,
            list_filter(string_split(replace(a, '\', '/'), '/'), lambda x: x <> '') AS pa,
            list_filter(string_split(replace(b, '\', '/'), '/'), lambda x: x <> '') AS pb FROM pairs)
        SELECT page_id, a = b OR pa[greatest(len(pa) - 2, 1):] = pb[greatest(len(pb) - 2, 1):] AS same FROM parts""",
)
def suffixes(spark: SparkSession, sf: str) -> DataFrame:
    left = F.col("path")
    right = by_mod(F.col("page_id"), F.concat(F.lit("/mnt/copy/"), left), F.concat(left, F.lit(".bak")), left)
    return page_paths(spark, sf).select("page_id", L.same_path_suffix(left, right).alias("same"))


_NAMES = ("x/SA1.WAV", "y/sa2.wav", "z/Hin_0069_Eng_m_0000.wav", "z/Mal_0028_Mal_f_0001.wav", "q/plain.wav")


@query(
    "scl_name_predicates",
    f"""SELECT o_orderkey, upper(b) IN ('SA1.WAV','SA2.WAV') AS fixed,
          CASE lower(string_split(replace(b, '.wav', ''), '_')[4]) WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' ELSE 'Unknown' END AS derived
        FROM (SELECT o_orderkey, list_last(string_split({words_sql('o_orderkey', *_NAMES)}, '/')) AS b FROM orders)""",
)
def names(spark: SparkSession, sf: str) -> DataFrame:
    path = words(F.col("o_orderkey"), *_NAMES)
    return load(spark, sf, "orders").select(
        "o_orderkey",
        L.is_fixed_name(path, ("SA1.WAV", "SA2.WAV")).alias("fixed"),
        L.plain_label(L.name_part(path, 3)).alias("derived"),
    )


@query(
    "scl_id_parse",
    """SELECT o_orderkey, concat('CUST_', o_custkey) AS entity_id,
         CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (o_orderkey % 1000)::INT END AS item_no,
         CASE o_orderkey % 4 WHEN 1 THEN '2' WHEN 2 THEN '_noise' END AS variant FROM orders WHERE o_orderkey % 4 < 3
       UNION ALL SELECT o_orderkey, concat('cust', o_custkey), NULL, NULL FROM orders WHERE o_orderkey % 4 = 3""",
)
def ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = F.concat(F.lit("feat/CUST_"), F.col("o_custkey").cast("string"), F.lit("_"), (key % 1000).cast("string"))
    name = by_mod(
        key, F.concat(base, F.lit(".npz")), F.concat(base, F.lit("_aug2.npz")), F.concat(base, F.lit("_aug_noise.npz")),
        F.concat(F.lit("feat/cust"), F.col("o_custkey").cast("string"), F.lit(".npz")),
    )
    parsed = L.parse_item_name(name)
    return load(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in parsed.items()])


@query(
    "scl_id_facets",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'hin' WHEN 1 THEN 'tam' ELSE 'kan' END ELSE '' END AS lang,
         CASE WHEN s_suppkey % 10 BETWEEN 1 AND 8 THEN (s_suppkey % 10)::INT ELSE 0 END AS region FROM supplier""",
)
def facets(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    entity = F.concat(by_mod(key, F.lit("NISP_"), F.lit("X_")), words(key, "Hin", "Tam", "Kan"), F.lit("_"), key.cast("string"))
    path = F.concat(F.lit("/root/dr"), (key % 10).cast("string"), F.lit("/f.wav"))
    return load(spark, sf, "supplier").select(
        "s_suppkey", L.id_language(entity, "NISP").alias("lang"), L.path_region(path).alias("region")
    )


# Known sources and the prefixes that give them away.
SOURCES = {"TIMIT": 0, "NISP": 1, "CELEB": 2, "HEIGHTCELEB": 2, "VOXCELEB": 2, "EXTERNAL": 2}
_CELEB = ("CELEB_", "HEIGHTCELEB_", "VOXCELEB_", "EXTERNAL_")
ID_PREFIXES = {"TIMIT": ("TIMIT_",), "NISP": ("NISP_",), "CELEB": _CELEB}
NAME_PREFIXES = {"TIMIT": ("TIMIT_",), "CELEB": _CELEB}
_DECLARED = ("voxceleb ", "??", None)
_IDS = ("timit_1", "abc", "External_9", "nisp_3", "zzz")
_FILES = ("/d/TIMIT_1.npz", "/d/celeb_1.npz", "/d/other.npz", "/d/x.npz", "/d/y.npz", "/d/z.npz", "/d/q.npz")


@query(
    "scl_source_infer",
    f"""SELECT o_orderkey, source, CASE source WHEN 'TIMIT' THEN 0 WHEN 'NISP' THEN 1 ELSE 2 END AS source_id FROM (
         SELECT o_orderkey, coalesce(CASE WHEN upper(trim(d)) IN ('TIMIT','NISP','CELEB','HEIGHTCELEB','VOXCELEB','EXTERNAL') THEN upper(trim(d)) END,
           CASE WHEN i ILIKE 'timit\\_%' ESCAPE '\\' THEN 'TIMIT' WHEN i ILIKE 'nisp\\_%' ESCAPE '\\' THEN 'NISP' WHEN i ILIKE 'external\\_%' ESCAPE '\\' THEN 'CELEB' END,
           CASE WHEN f ILIKE '%/timit\\_%' ESCAPE '\\' THEN 'TIMIT' WHEN f ILIKE '%/celeb\\_%' ESCAPE '\\' THEN 'CELEB' END, 'NISP') AS source
         FROM (SELECT o_orderkey, {words_sql('o_orderkey', *_DECLARED)} AS d, {words_sql('o_orderkey', *_IDS)} AS i, {words_sql('o_orderkey', *_FILES)} AS f FROM orders))""",
)
def sources(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    name, number = L.infer_source(
        words(key, *_DECLARED), words(key, *_IDS), words(key, *_FILES), SOURCES, ID_PREFIXES, NAME_PREFIXES, "NISP"
    )
    return load(spark, sf, "orders").select("o_orderkey", name.alias("source"), number.alias("source_id"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "scl_meta_vector",
    with_sql("ent")
    + """SELECT entity_id, d.i AS dim, d.v AS value FROM (SELECT entity_id, unnest(list_zip(range(0, 20), vec)) AS z FROM (
         SELECT entity_id, list_concat([g::DOUBLE, (source = 'ASIA')::INT::DOUBLE, nullif(age, 20.0), (age = 20.0)::INT::DOUBLE, weight,
            (weight IS NULL)::INT::DOUBLE, round(ln(1.0 + 1 + entity_id % 9), 6)],
            [(segment = 'AUTOMOBILE')::INT::DOUBLE, (segment = 'BUILDING')::INT::DOUBLE, (segment = 'FURNITURE')::INT::DOUBLE,
             (segment = 'HOUSEHOLD')::INT::DOUBLE, (segment = 'MACHINERY')::INT::DOUBLE],
            list_transform(range(1, 9), lambda k: (entity_id % 11 = k)::INT::DOUBLE)) AS vec FROM ent)),
       LATERAL (SELECT z[1]::INT AS i, z[2] AS v) d""",
)
def meta_vector(spark: SparkSession, sf: str) -> DataFrame:
    key, age = F.col("entity_id"), F.nullif(F.col("age"), F.lit(20.0))
    flag = lambda c: c.cast("double")
    values = [
        F.col("g").cast("double"), flag(F.col("source") == "ASIA"), age, flag(age.isNull()),
        F.col("weight"), flag(F.col("weight").isNull()), F.round(F.log1p((F.lit(1) + key % 9).cast("double")), 6),
        *[flag(F.col("segment") == s) for s in _SEGMENTS],
        *[flag(key % 11 == i) for i in range(1, 9)],
    ]
    return entities(spark, sf).select("entity_id", F.posexplode(F.array(*values)).alias("dim", "value"))


@query(
    "scl_fixed_bins",
    with_sql("items")
    + """SELECT item_id, CASE WHEN pred < 160 THEN 'short' WHEN pred < 175 THEN 'medium' ELSE 'tall' END AS target,
         CASE WHEN duration < 2.5 THEN 'short' WHEN duration < 5 THEN 'medium' ELSE 'long' END AS dur,
         CASE WHEN drift IS NULL THEN 'unknown' WHEN drift < 0.5 THEN 'low' WHEN drift < 0.75 THEN 'medium' ELSE 'high' END AS qual FROM items""",
)
def bins(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        "item_id",
        N.target_bin(F.col("pred")).alias("target"),
        N.duration_bin(F.col("duration")).alias("dur"),
        N.quality_bin(F.col("drift")).alias("qual"),
    )


@query(
    "scl_subgroup_label",
    """SELECT p_partkey, CASE WHEN v < 160 THEN concat('Short ', p_type, ' (< 160 cm)')
         WHEN v <= 175 THEN concat('Medium ', p_type, ' (160 - 175 cm)') ELSE concat('Tall ', p_type, ' (> 175 cm)') END AS label
       FROM (SELECT p_partkey, p_type, 150 + p_size AS v FROM part)""",
)
def subgroup(spark: SparkSession, sf: str) -> DataFrame:
    value = (F.lit(150) + F.col("p_size")).cast("double")
    return load(spark, sf, "part").select("p_partkey", N.subgroup_label(value, F.col("p_type")).alias("label"))


@query(
    "scl_normalize_target",
    with_sql("ent")
    + """, st AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM ent WHERE split = 'train')
       SELECT entity_id, round((y - m) / s, 6) AS z, round((y - m) / s * s + m, 6) AS back, y - 0.0::DOUBLE AS plain FROM ent CROSS JOIN st""",
)
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    stats = rows.filter("split = 'train'").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    both = stats.select(F.struct("m", "s")).scalar()
    missing = F.lit(None).cast("double")
    z = N.normalize(F.col("y"), both["m"], both["s"])
    return rows.select(
        "entity_id",
        F.round(z, 6).alias("z"),
        F.round(N.denormalize(z, both["m"], both["s"]), 6).alias("back"),
        N.normalize(F.col("y"), missing, missing).alias("plain"),
    )


_IW = """least(greatest(speech, 0.1), 1.25) AS a, CASE WHEN drift IS NULL THEN 1 ELSE least(greatest(drift, 0.2), 1.1) END AS b,
  least(greatest(1.0::DOUBLE - clipped * 4.0, 0.2), 1.0) AS c"""


@query(
    "scl_item_weight",
    with_sql("items") + f"SELECT item_id, round(least(greatest(a * b * c, 0.05), 1.5), 6) AS w FROM (SELECT item_id, {_IW} FROM items)",
)
def item_weights(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        "item_id", F.round(Q.item_weight(F.col("speech"), F.col("drift"), F.col("clipped")), 6).alias("w")
    )


def reliability_columns() -> dict:
    return {
        "capture": F.col("quality"), "speech": F.col("speech"), "snr": F.col("snr"), "clipped": F.col("clipped"),
        "distance": F.col("distance"), "voiced": F.col("voiced"), "duration": F.col("duration"),
        "frames": F.col("frames"), "std": F.sqrt("var"), "drift": F.col("drift"), "ood": F.lit(None).cast("double"),
    }


def c01(expr: str) -> str:
    return f"least(greatest({expr}, 0.0), 1.0)"


RELIABILITY_SQL = f"""greatest(least(0.20 * {c01('quality')} + 0.10 * {c01('(speech - 0.35) / 0.55::DOUBLE')} + 0.10 * {c01('(snr - 5.0) / 20.0::DOUBLE')}
  + 0.10 * {c01('1.0 - clipped / 0.08::DOUBLE')} + 0.10 * {c01('1.0 - abs(distance - 18.0) / 30.0::DOUBLE')} + 0.10 * {c01('(voiced - 0.20) / 0.70::DOUBLE')}
  + 0.05 * {c01('duration / 4.0::DOUBLE')} + 0.05 * {c01('sqrt(frames / 200.0::DOUBLE)')} + 0.10 * {c01('1.0 / (1.0 + sqrt(var) / 4.0::DOUBLE)')}
  + 0.10 * CASE WHEN drift IS NULL THEN 1.0 ELSE exp(-0.5 * pow(least(abs(drift), 3.0), 2)) END, 1.0), 0.05)"""


@query(
    "scl_reliability",
    with_sql("items")
    + f"SELECT item_id, round(r, 6) AS r, round(ln(least(greatest(r, 0.0001), 0.9999) / (1.0::DOUBLE - least(greatest(r, 0.0001), 0.9999))), 6) AS lg FROM (SELECT item_id, {RELIABILITY_SQL} AS r FROM items)",
)
def reliabilities(spark: SparkSession, sf: str) -> DataFrame:
    scored = items(spark, sf).select("item_id", Q.reliability(reliability_columns(), 200.0).alias("r"))
    return scored.select("item_id", F.round("r", 6).alias("r"), F.round(Q.logit(F.col("r")), 6).alias("lg"))


@query(
    "scl_uncertainty_temper",
    with_sql("items") + "SELECT item_id, round(least(greatest(1.0 / (1.0 + sqrt(var) / 3.0::DOUBLE), 0.05), 1.0), 6) AS t FROM items",
)
def tempers(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", F.round(Q.uncertainty_temper(F.sqrt("var")), 6).alias("t"))


_GATE = """list_filter([CASE WHEN quality < 0.55 THEN 'low_capture_quality' END, CASE WHEN speech < 0.55 THEN 'low_speech_ratio' END,
  CASE WHEN snr < 10 THEN 'low_snr' END, CASE WHEN distance > 30 THEN 'far_microphone' END, CASE WHEN clipped > 0.03 THEN 'clipped_input' END], lambda x: x IS NOT NULL)"""
_BLANK = "item_id % 11 = 0"


@query(
    "scl_quality_gate",
    with_sql("items")
    + f"""SELECT item_id, NOT blank AND len(f) = 0 AS strict_ok, TRUE AS soft_ok,
         CASE WHEN blank THEN 'missing_quality_metadata' ELSE array_to_string(f, '|') END AS why,
         CASE WHEN blank THEN 0.2::DOUBLE ELSE w END AS strict_w,
         CASE WHEN blank THEN 0.2::DOUBLE WHEN len(f) > 0 THEN greatest(w * 0.35::DOUBLE, 0.05) ELSE w END AS soft_w
       FROM (SELECT item_id, {_BLANK} AS blank, {_GATE} AS f, least(greatest(quality, 0.05), 1.0) AS w FROM items)""",
)
def gate(spark: SparkSession, sf: str) -> DataFrame:
    some = F.col("item_id") % 11 != 0
    cols = [F.when(some, F.col(c)) for c in ("quality", "speech", "snr", "distance", "clipped")]
    ok = F.when(some, F.lit(True))
    strict = Q.quality_gate(*cols, ok)
    soft = Q.quality_gate(*cols, ok, Q.GatePolicy(strict=False))
    return items(spark, sf).select(
        "item_id",
        strict[0].alias("strict_ok"), soft[0].alias("soft_ok"), F.array_join(strict[1], "|").alias("why"),
        strict[2].alias("strict_w"), soft[2].alias("soft_w"),
    )


@query(
    "scl_capture_quality",
    with_sql("items")
    + f"""SELECT item_id, round(0.35 * a + 0.20 * b + 0.15 * c + 0.15 * h + 0.15 * t, 6) AS quality, round(dist, 6) AS distance,
         CASE WHEN dist <= 20 THEN 'near' WHEN dist <= 40 THEN 'mid' ELSE 'far' END AS band,
         round(least(greatest(0.25 + 0.35 * b + 0.20 * a + 0.10 * t, 0.2), 0.9), 6) AS confidence,
         array_to_string(list_filter([CASE WHEN speech < 0.45 THEN 'low_speech_coverage' END, CASE WHEN snr < 8 THEN 'low_snr' END,
           CASE WHEN clipped > 0.02 THEN 'input_clipping' END, CASE WHEN dist > 45 THEN 'far_microphone' END,
           CASE WHEN voiced > 0.30 THEN 'reverb_heavy' END], lambda x: x IS NOT NULL), '|') AS warnings
       FROM (SELECT *, least(greatest(75.0::DOUBLE - 55.0 * {c01('0.35 * a + 0.20 * b + 0.20 * h + 0.15 * t + 0.10 * c')}, 12.0), 80.0) AS dist FROM (
         SELECT item_id, speech, snr, clipped, voiced, {c01('(snr - 6.0) / 18.0::DOUBLE')} AS a, {c01('(speech - 0.35) / 0.50::DOUBLE')} AS b,
           1.0::DOUBLE - {c01('clipped / 0.02::DOUBLE')} AS c, {c01('(22.0 - distance) / 18.0::DOUBLE')} AS h,
           1.0::DOUBLE - {c01('voiced / 0.30::DOUBLE')} AS t FROM items))""",
)
def captures(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.capture_quality(F.col("snr"), F.col("speech"), -F.col("distance"), F.col("voiced"), F.col("clipped"))
    return items(spark, sf).select(
        "item_id",
        *[F.round(out[n], 6).alias(n) for n in ("quality", "distance", "confidence")],
        out["band"].alias("band"),
        F.array_join(out["warnings"], "|").alias("warnings"),
    )


@query(
    "scl_capture_advice",
    with_sql("items")
    + """SELECT item_id, CASE WHEN len(a) > 0 THEN array_to_string(a, '; ') WHEN item_id % 2 = 0 THEN 'try another recording' END AS advice
       FROM (SELECT item_id, list_filter([CASE WHEN speech < 0.55 THEN 'talk without long pauses' END,
         CASE WHEN snr < 10 THEN 'find a place with less background noise' END,
         CASE WHEN distance > 25 THEN 'bring the microphone closer' END], lambda x: x IS NOT NULL) AS a FROM items)""",
)
def advice(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("item_id") % 2 != 0
    text = Q.capture_advice(F.col("speech"), F.col("snr"), F.col("distance"), ok)
    return items(spark, sf).select("item_id", text.alias("advice"))


OOD_FIELDS = ("duration", "speech", "snr", "quality", "drift")


def reference_summary(rows: DataFrame, fields=OOD_FIELDS):
    """One struct of means and standard deviations over the rows."""
    parts = [F.avg(f).alias(f"m_{f}") for f in fields] + [F.stddev_pop(f).alias(f"s_{f}") for f in fields]
    stats = rows.agg(*parts)
    return stats.select(F.struct(*stats.columns)).scalar()


_OOD = ", ".join(
    f"CASE WHEN abs(s_{f}) > 1e-6 THEN abs({f} - m_{f}) / s_{f} ELSE abs({f} - m_{f}) END" for f in OOD_FIELDS
)
_REF = "ref AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in OOD_FIELDS) + " FROM items WHERE item_id % 3 = 0)"
SCORED_SQL = f"""scored AS (SELECT items.*, greatest({_OOD}) AS ood FROM items CROSS JOIN ref),
  conf AS (SELECT *, least(greatest(0.5 / (1.0 + sqrt(var) / 8.0::DOUBLE) + 0.5 * quality, 0.0), 1.0) / (1.0 + ood / 4.0::DOUBLE) AS conf FROM scored)"""


def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf)
    ref = reference_summary(rows.filter("item_id % 3 = 0"))
    score = Q.ood_score(
        {f: F.col(f) for f in OOD_FIELDS},
        {f: F.col(f"_ref.m_{f}") for f in OOD_FIELDS},
        {f: F.col(f"_ref.s_{f}") for f in OOD_FIELDS},
    )
    scored = rows.withColumn("_ref", ref).withColumn("ood", score).drop("_ref")
    return scored.withColumn("conf", Q.confidence(F.sqrt("var"), F.col("quality"), F.col("ood")))


@query("scl_ood_score", with_sql("items", more=f"{_REF}, {SCORED_SQL}") + "SELECT item_id, round(ood, 6) AS ood FROM scored")
def ood(spark: SparkSession, sf: str) -> DataFrame:
    return scored_items(spark, sf).select("item_id", F.round("ood", 6).alias("ood"))


@query("scl_confidence", with_sql("items", more=f"{_REF}, {SCORED_SQL}") + "SELECT item_id, round(conf, 6) AS conf FROM conf")
def confidences(spark: SparkSession, sf: str) -> DataFrame:
    return scored_items(spark, sf).select("item_id", F.round("conf", 6).alias("conf"))


@query(
    "scl_decision",
    with_sql("items", more=f"{_REF}, {SCORED_SQL}")
    + f"""SELECT item_id, len(d) = 0 AS accepted, array_to_string(d, '|') AS why FROM (
         SELECT item_id, list_sort(list_distinct(list_concat({_GATE}, list_filter([CASE WHEN sqrt(var) > 5.0 THEN 'high_predictive_uncertainty' END,
           CASE WHEN ood > 1.5 THEN 'feature_ood' END, CASE WHEN conf < 0.35 THEN 'low_confidence' END], lambda x: x IS NOT NULL)))) AS d FROM conf)""",
)
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col(c) for c in ("quality", "speech", "snr", "distance", "clipped")]
    _, warnings, _ = Q.quality_gate(*cols, F.lit(True))
    policy = Q.GatePolicy(max_std=5.0, max_ood=1.5)
    accepted, why = Q.decision(warnings, F.sqrt("var"), F.col("ood"), F.col("conf"), policy)
    return scored_items(spark, sf).select("item_id", accepted.alias("accepted"), F.array_join(why, "|").alias("why"))


@query(
    "scl_item_outcome",
    with_sql("items")
    + """SELECT item_id, duration < 1.0 AS flagged, duration < 1.5 AS dropped, duration > 10.0 AS truncated,
         CASE WHEN duration < 1.0 THEN '<1.0s_voiced_after_vad' WHEN duration < 1.5 THEN '<1.5s_after_vad' END AS reason,
         least(duration, 10.0) AS clean FROM items""",
)
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.item_outcome(F.col("duration"))
    return items(spark, sf).select("item_id", *[c.alias(n) for n, c in out.items()])


@query(
    "scl_sample_weight",
    with_sql("ent")
    + """SELECT entity_id, CASE WHEN y < 160 THEN 1.8::DOUBLE WHEN y >= 175 THEN 1.35 ELSE 1 END AS edge,
         (CASE WHEN y < 160 THEN 2.5::DOUBLE ELSE 1 END) * (CASE WHEN y < 152 THEN 4.0::DOUBLE ELSE 1 END) AS short,
         CASE WHEN y >= 160 AND y < 175 THEN 2.5::DOUBLE ELSE 1 END AS medium,
         (CASE WHEN y < 160 AND g = 1 THEN 6.0::DOUBLE WHEN y < 160 AND g = 0 THEN 3 ELSE 1 END) * (CASE WHEN y < 152 THEN 4.0::DOUBLE ELSE 1 END) AS short_group,
         round(least(greatest((CASE WHEN y < 160 THEN 3.0::DOUBLE WHEN y >= 175 THEN 1.5 ELSE 1 END) * (CASE WHEN y < 160 AND g = 1 THEN 2.5::DOUBLE ELSE 1 END)
           * (CASE WHEN y < 160 AND source = 'ASIA' THEN 1.3::DOUBLE ELSE 1 END) * (CASE WHEN y <= 152 THEN 4.0::DOUBLE ELSE 1 END)
           * (CASE WHEN y >= 190 THEN 2.0::DOUBLE ELSE 1 END), 0.001), 25.0), 6) AS configured FROM ent""",
)
def sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    y, g = F.col("y"), F.col("g")
    name = F.when(g == 1, "male").otherwise("female")
    configured = Wt.configured_weight(
        y, name, F.col("source"), {"short": 3.0, "tall": 1.5}, {"male_short": 2.5}, {"asia_short": 1.3},
        extreme_low=(152.0, 4.0), extreme_high=(190.0, 2.0),
    )
    return entities(spark, sf).select(
        "entity_id",
        Wt.edge_weight(y).alias("edge"),
        *[Wt.emphasis_weight(y, g, s).alias(s) for s in ("short", "medium", "short_group")],
        F.round(configured, 6).alias("configured"),
    )


@query(
    "scl_fingerprint",
    """SELECT n_regionkey, count(*) AS n_rows, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS hash_sum_0,
         sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS hash_sum_1, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR AS hash_sum_2
       FROM (SELECT n_regionkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name})::VARCHAR) AS h
             FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_regionkey""",
)
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").join(
        load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return H.table_fingerprint(rows, ("c_name", "c_custkey", "c_mktsegment"), ("n_regionkey",))


@query(
    "scl_config_override",
    """WITH layers AS (SELECT user_id AS run, event_type AS key, (props->>'k')::INT AS value, 1 AS level, event_id AS seq FROM events
         UNION ALL SELECT DISTINCT user_id, 'opt.' || k, 0, 0, 0 FROM events CROSS JOIN (VALUES ('click'), ('view'), ('depth')) d(k)
         UNION ALL SELECT user_id, 'opt.' || event_type, (props->>'k')::INT, 1, event_id FROM events)
       SELECT run, key, arg_max(value, level * 1000000000000 + seq) AS value FROM layers GROUP BY run, key""",
)
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    value = F.get_json_object("props", "$.k").cast("int").alias("value")
    said = events.select(
        F.col("user_id").alias("run"), value, F.col("event_id").alias("seq"),
        F.explode(F.array("event_type", F.concat(F.lit("opt."), "event_type"))).alias("key"),
    )
    base = events.select(F.col("user_id").alias("run")).distinct().select(
        "run", F.lit(0).alias("value"), F.lit(0).cast("long").alias("seq"),
        F.explode(F.array(*[F.lit(f"opt.{k}") for k in ("click", "view", "depth")])).alias("key"),
    )
    return last_wins([base, said], ["run", "key"], "value", "seq")
