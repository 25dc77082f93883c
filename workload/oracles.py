"""Plain SQL (DuckDB dialect) for the registered queries, over the given tables only."""

from __future__ import annotations

from seamstat import schema as sm
from seamstat.functions import lexicons as lex
from workload import derived as dv

SQL: dict[str, str] = {}
PLACES = 6
IMAGE_PLACES = 9

# Character classes in the regular-expression dialect of the checking engine.
BLANK = (
    r"\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}"
)
UPPER = (
    r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}"
    r"\x{1F170}-\x{1F189}]"
)
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)
EMOJI = r"[\x{2601}-\x{27BE}]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def col(name: str) -> str:
    return f'"{name}"'


def cols(names) -> str:
    return ", ".join(col(n) for n in names)


def rd(expression: str, alias: str | None = None, places: int = PLACES) -> str:
    """Round half up on the decimal spelling, as the compared side does."""
    text = f"CAST(round(CAST({expression} AS DECIMAL(38, 16)), {places}) AS DOUBLE)"
    return f'{text} AS "{alias}"' if alias else text


def lower(text: str) -> str:
    # The one capital letter whose lower case has two characters.
    return f"lower(replace({text}, chr(304), 'i' || chr(775)))"


# -- input tables -------------------------------------------------------------------------

REVIEWS = f"""
reviews AS (
  SELECT o.o_orderkey AS review_id,
    CASE WHEN o.o_orderkey % 11 <> 0 THEN list_extract([{lits(dv.TITLES)}], o.o_custkey % {len(dv.TITLES)} + 1) END AS "Title",
    CASE WHEN d.text IS NOT NULL THEN said || ' ' || d.text
         WHEN o.o_orderkey % 17 <> 0 THEN said END AS "Review Text",
    CASE WHEN o.o_orderkey % 37 <> 0 THEN CAST(18 + o.o_custkey % 85 AS DOUBLE) END AS "Age",
    CASE WHEN o.o_orderkey % 41 <> 0 THEN CAST(o.o_orderkey % 15 AS DOUBLE) END AS "Positive Feedback Count",
    CAST(stars AS DOUBLE) AS "Rating",
    CASE WHEN o.o_orderkey % 29 <> 0 THEN o.c_mktsegment END AS "Division Name",
    o.p_brand AS "Department Name", o.p_type AS "Class Name",
    CASE WHEN o.o_orderkey % 53 <> 0 THEN CAST(stars + o.o_custkey % 3 >= 5 AS INTEGER) END AS "Recommended IND"
  FROM (
    SELECT k.*, c.c_mktsegment, p.p_brand, p.p_type,
      1 + (k.o_orderkey * 7 + k.o_custkey) % 5 AS stars,
      list_extract([{lits(dv.SENTENCES)}], k.o_orderkey % {len(dv.SENTENCES)} + 1) || ' The ' || p.p_name || '.' AS said
    FROM orders k
    JOIN customer c ON c.c_custkey = k.o_custkey
    JOIN part p ON p.p_partkey = k.o_orderkey % (SELECT count(*) FROM part)
  ) o LEFT JOIN documents d ON d.doc_id * {dv.DOCUMENT_STRIDE} = o.o_orderkey
)"""

CLEANED = REVIEWS + """,
cleaned AS (
  SELECT review_id, coalesce("Title", '') AS "Title", coalesce("Review Text", '') AS "Review Text",
    coalesce("Age", 0.0::DOUBLE) AS "Age",
    coalesce("Positive Feedback Count", 0.0::DOUBLE) AS "Positive Feedback Count",
    coalesce("Rating", 0.0::DOUBLE) AS "Rating",
    coalesce("Division Name", 'Unknown') AS "Division Name",
    coalesce("Department Name", 'Unknown') AS "Department Name",
    coalesce("Class Name", 'Unknown') AS "Class Name", "Recommended IND"
  FROM reviews WHERE "Recommended IND" IS NOT NULL
)"""


def _answer_value(key: str, k: int) -> str:
    n = "o_orderkey"
    if key == "purchase_channel":
        return f"list_extract([{lits(dv.CHANNELS)}], {n} % {len(dv.CHANNELS)} + 1)"
    if key == "size_vs_usual":
        return f"list_extract([{lits(dv.SIZES)}], {n} % {len(dv.SIZES)} + 1)"
    if key in dv.BOOLEAN_KEYS:
        return f"({n} + {k}) % 2 = 0"
    if key in dv.LIKERT_KEYS:
        return f"1 + ({n} * 3 + {k}) % 5"
    if key in dv.SHARE_KEYS:
        return f"CAST(({n} * 7 + {k}) % 21 AS DOUBLE) / 20.0::DOUBLE"
    return {
        "days_since_purchase": f"{n} % 91",
        "comfort_hours": f"CAST({n} % 25 AS DOUBLE) / 2.0::DOUBLE",
        "worn_before_review": f"{n} % 21",
    }[key]


ANSWERS = (
    "answers AS (SELECT o_orderkey AS review_id, "
    + ", ".join(
        f"CASE WHEN (o_orderkey + {k}) % 7 <> 0 THEN {_answer_value(key, k)} END AS {key}"
        for k, key in enumerate(dv.ANSWER_ORDER)
    )
    + f" FROM orders WHERE o_orderpriority NOT IN ({lits(dv.UNSURVEYED)}))"
)


def _code(key: str) -> str:
    if key in sm.CHOICE_CODES:
        whens = " ".join(f"WHEN {lit(a)} THEN {c}" for a, c in sm.CHOICE_CODES[key].items())
        return f"CASE {key} {whens} ELSE 0.0 END"
    if key in dv.BOOLEAN_KEYS:
        return f"CASE WHEN {key} THEN 1.0 ELSE 0.0 END"
    return key


ENCODED = ANSWERS + ",\nencoded AS (SELECT answers.*, " + ", ".join(
    f"CAST(CASE WHEN {name[7:]} IS NULL THEN {default} ELSE {_code(name[7:])} END AS DOUBLE) AS {name}"
    for name, default in sm.SURVEY_DEFAULTS.items()
) + " FROM answers)"

PIXELS = """
pixels AS (
  SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    ((CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256 AS r,
    ((CAST(floor(CAST(e AS DOUBLE) * 3000) AS BIGINT) % 256) + 256) % 256 AS g,
    ((CAST(floor(CAST(e AS DOUBLE) * 7000) AS BIGINT) % 256) + 256) % 256 AS b
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings)
)"""
IMAGES = PIXELS + """,
shaded AS (SELECT image_id, x, y, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b,
  0.299::DOUBLE * (r / 255.0::DOUBLE) + 0.587::DOUBLE * (g / 255.0::DOUBLE) + 0.114::DOUBLE * (b / 255.0::DOUBLE) AS gray FROM pixels),
edged AS (SELECT *,
  coalesce(abs(gray - lag(gray) OVER (PARTITION BY image_id, y ORDER BY x)), 0) AS dx,
  coalesce(abs(gray - lag(gray) OVER (PARTITION BY image_id, x ORDER BY y)), 0) AS dy FROM shaded),
size AS (SELECT image_id, count(*)::DOUBLE AS n FROM shaded GROUP BY image_id),
bins AS (SELECT image_id, least(CAST(floor(gray * 32) AS INTEGER), 31) AS bin, count(*) AS k FROM shaded GROUP BY ALL),
grid AS (SELECT s.image_id, s.n, coalesce(b.k, 0) * 32.0::DOUBLE / s.n + 1e-12::DOUBLE AS d
  FROM size s CROSS JOIN range(32) AS t(slot) LEFT JOIN bins b ON b.image_id = s.image_id AND b.bin = t.slot),
entropy AS (SELECT image_id, -sum(d * log2(d)) AS h FROM grid GROUP BY image_id),
images AS (
  SELECT e.image_id, avg(gray) AS img_brightness, stddev_pop(gray) AS img_contrast,
    avg(greatest(r, g, b) - least(r, g, b)) AS img_saturation,
    CAST((max(x) + 1)::DOUBLE / (max(y) + 1) AS DOUBLE) AS img_aspect_ratio,
    avg(r) / (avg(b) + 1e-6::DOUBLE) AS img_warm_tone_ratio, avg(dx + dy) AS img_edge_density,
    any_value(h.h) AS img_color_entropy, avg(r) AS img_dominant_red, avg(g) AS img_dominant_green,
    avg(b) AS img_dominant_blue, 1.0::DOUBLE AS img_has_image
  FROM edged e JOIN entropy h ON h.image_id = e.image_id GROUP BY e.image_id
)"""


# -- text features ------------------------------------------------------------------------


def _count(words) -> str:
    return f"CAST(len(list_filter(tok, lambda w: w IN ({lits(words)}))) AS BIGINT)"


def _present(words) -> str:
    return "CAST(" + " + ".join(f"list_contains(tok, {lit(w)})::INT" for w in words) + " AS BIGINT)"


def _phrases(phrases) -> str:
    return "(" + " + ".join(f"contains(low, {lit(p)})::INT" for p in phrases) + ")"


def _char(c: str) -> str:
    return f"CAST(length(c) - length(replace(c, '{c}', '')) AS BIGINT)"


def _matches(pattern: str) -> str:
    return f"len(regexp_extract_all(c, {lit(pattern)}))"


UNIQUE = "CAST(len(list_distinct(tok)) AS DOUBLE) / greatest(len(tok), 1)"
TEXT_SQL = {name: _count(words) for name, words in lex.COUNTED.items()}
TEXT_SQL |= {name: _present(words) for name, words in lex.PRESENT.items()}
TEXT_SQL |= {
    "nlp_char_count": "CAST(length(c) AS BIGINT)",
    "nlp_word_count": "CAST(len(tok) AS BIGINT)",
    "nlp_sentence_count": "CAST(sents AS BIGINT)",
    "nlp_avg_word_len": "coalesce(CAST(list_sum(list_transform(tok, lambda w: length(w))) AS DOUBLE) / nullif(len(tok), 0), 0.0)",
    "nlp_unique_word_ratio": UNIQUE,
    "nlp_exclamation_count": _char("!"),
    "nlp_question_count": _char("?"),
    "nlp_uppercase_ratio": f"CAST({_matches(UPPER)} AS DOUBLE) / greatest(length(c), 1)",
    "nlp_digit_count": f"CAST({_matches(DIGIT)} AS BIGINT)",
    "nlp_sentiment_net": f"{_count(lex.POSITIVE)} - {_count(lex.NEGATIVE)}",
    "nlp_recommend_signal": f"CAST({_phrases(lex.RECOMMEND_PHRASES)} AS BIGINT)",
    "nlp_avg_sentence_len": "CAST(len(tok) AS DOUBLE) / sents",
    "nlp_repetition_ratio": f"1.0::DOUBLE - {UNIQUE}",
    "nlp_emoji_count": f"CAST({_matches(EMOJI)} AS BIGINT)",
    "nlp_hashtag_count": _char("#"),
    "vis_photo_accuracy_signal": f"CAST({_phrases(lex.PHOTO_MATCH_PHRASES)} - {_phrases(lex.PHOTO_MISMATCH_PHRASES)} AS BIGINT)",
    "vis_multicolor_signal": f"CAST({_count(lex.COLOR)} >= 2 AS BIGINT)",
}


def text_ctes(source: str, key: str, title: str, review: str, names) -> str:
    """CTE ``texts``: key and the named features of every row of ``source``."""
    features = ", ".join(f"{TEXT_SQL[n]} AS {n}" for n in names)
    return f"""
raw_text AS (SELECT {key}, coalesce({title}, '') || ' ' || coalesce({review}, '') AS c FROM {source}),
low_text AS (SELECT *, {lower('c')} AS low FROM raw_text),
tok_text AS MATERIALIZED (SELECT *, regexp_extract_all(low, '[a-zA-Z'']+') AS tok,
  greatest(len(list_filter(regexp_split_to_array(c, '[.!?]+'), lambda s: regexp_matches(s, '[^{BLANK}]'))), 1) AS sents FROM low_text),
texts AS MATERIALIZED (SELECT {key}, {features} FROM tok_text)"""


ALL_TEXT = sm.NLP_FEATURES + sm.VISUAL_FEATURES
CLEAN_TEXTS = CLEANED + "," + text_ctes("cleaned", "review_id", '"Title"', '"Review Text"', ALL_TEXT)

MARGIN = " + ".join([f"{dv.INTERCEPT}::DOUBLE"] + [f"{w}::DOUBLE * {col(n)}" for n, w in dv.WEIGHTS.items()])


def scored_cte(source: str, name: str = "scored") -> str:
    return f"""
{name} AS (SELECT *, CASE WHEN prediction = 1 THEN 'Recommended' ELSE 'Not recommended' END AS recommended_label
  FROM (SELECT *, CAST(score > 0.5 AS INTEGER) AS prediction
    FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({MARGIN}))) AS score FROM {source})))"""


SCORED = CLEAN_TEXTS + """,
featured AS (SELECT * FROM cleaned JOIN texts USING (review_id)),""" + scored_cte("featured")
SCORED_ANSWERS = SCORED + ",\n" + ANSWERS + """,
told AS (SELECT scored.*, """ + ", ".join(f"answers.{k}" for k in sm.ANSWER_KEYS) + """
  FROM scored LEFT JOIN answers USING (review_id))"""


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


SURVEY_JOINED = CLEANED + ",\n" + ENCODED + """,
surveyed AS (SELECT cleaned.*, """ + ", ".join(
    f"coalesce(encoded.{n}, {v}::DOUBLE) AS {n}" for n, v in sm.SURVEY_DEFAULTS.items()
) + " FROM cleaned LEFT JOIN encoded USING (review_id))"

TAGS = """concat_ws(' ',
  CASE WHEN survey_return_likelihood >= 0.7::DOUBLE THEN 'high_return_intent' END,
  CASE WHEN survey_repurchase_likelihood >= 0.7::DOUBLE THEN 'high_repurchase_intent' END,
  CASE WHEN survey_fit_vs_expectation <= 2 THEN 'poor_fit_experience' END,
  CASE WHEN survey_color_accuracy <= 2 THEN 'color_mismatch_reported' END,
  CASE WHEN survey_size_vs_usual < 0 THEN 'runs_small' WHEN survey_size_vs_usual > 0 THEN 'runs_large' END,
  CASE WHEN survey_photo_uploaded >= 1 THEN 'product_photo_provided' END)"""
BASE_TEXT = strip('"Title" || \' \' || "Review Text"')
AUGMENTED = SURVEY_JOINED + f""",
augmented AS (SELECT *, {strip(f"{BASE_TEXT} || ' ' || {TAGS}")} AS text FROM surveyed)"""

FRAME = AUGMENTED + "," + text_ctes("cleaned", "review_id", '"Title"', '"Review Text"', ALL_TEXT) + ",\n" + IMAGES + """,
frame AS MATERIALIZED (SELECT a.*, t.* EXCLUDE (review_id), """ + ", ".join(
    rd(f"coalesce(i.{n}, 0.0)", n, IMAGE_PLACES) for n in sm.IMAGE_FEATURES
) + """ FROM augmented a JOIN texts t USING (review_id) LEFT JOIN images i ON i.image_id = a.review_id)"""

DIMENSION = "dimension(feature, ord, grp, modality, short, words, spoken) AS (VALUES " + ", ".join(
    "("
    + ", ".join(
        [
            lit(f.name), str(f.position), lit(f.group), lit(f.modality), lit(f.name[len(f.modality) + 1:]),
            lit(f.name.replace("_", " ")[:20]), lit(f.name[len(f.modality) + 1:].replace("_", " ")),
        ]
    )
    + ")"
    for f in sm.FEATURES
) + ")"


def long_ctes(source: str) -> str:
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in sm.ENGINEERED_COLUMNS)
    return f"""
{DIMENSION},
wide AS (SELECT review_id, {casts} FROM {source}),
melted AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (review_id)) INTO NAME feature VALUE value),
signals AS MATERIALIZED (SELECT review_id, m.feature, value, ord, grp, modality, short, words, spoken FROM melted m JOIN dimension d ON d.feature = m.feature)"""


LONG = FRAME + "," + long_ctes("frame")


def define(name: str, ctes: str, select: str) -> None:
    SQL[name] = f"WITH {ctes.strip()}\n{select.strip()}" if ctes else select.strip()


# -- cleaning and enrichment --------------------------------------------------------------

define("clean_reviews", CLEANED, "SELECT * FROM cleaned")
define("form_reviews", CLEANED, "SELECT * FROM cleaned")
define(
    "enrich_join",
    SURVEY_JOINED + ",\n" + IMAGES,
    "SELECT review_id, "
    + ", ".join([*sm.SURVEY_FEATURES, *[rd(f"coalesce(i.{n}, 0.0)", n, IMAGE_PLACES) for n in sm.IMAGE_FEATURES]])
    + " FROM surveyed LEFT JOIN images i ON i.image_id = review_id",
)
define(
    "model_frame",
    FRAME,
    "SELECT review_id, "
    + cols(sm.NUMERIC_COLUMNS + sm.CATEGORICAL_COLUMNS + [sm.TARGET_COLUMN, "text"])
    + " FROM frame",
)

# -- features -----------------------------------------------------------------------------

for name, names in (("nlp_features", sm.NLP_FEATURES), ("vision_text_features", sm.VISUAL_FEATURES)):
    define(
        name,
        REVIEWS + "," + text_ctes("reviews", "review_id", '"Title"', '"Review Text"', names),
        "SELECT * FROM texts",
    )
define(
    "nlp_documents",
    text_ctes("documents", "doc_id", "NULL", "text", sm.NLP_FEATURES),
    "SELECT * FROM texts",
)
define("image_stats", IMAGES, "SELECT image_id, " + ", ".join(rd(n, n, IMAGE_PLACES) for n in sm.IMAGE_FEATURES) + " FROM images")
IMAGE_TEN = [n for n in sm.IMAGE_FEATURES if n != "img_has_image"]
define(
    "image_profile",
    IMAGES,
    "SELECT image_id, descriptor, " + rd("v / CASE WHEN top = 0 THEN 1 ELSE top END", "relative")
    + " FROM (SELECT image_id, greatest(" + ", ".join(IMAGE_TEN) + ") AS top, unnest(["
    + lits(n[4:] for n in IMAGE_TEN) + "]) AS descriptor, unnest([" + ", ".join(IMAGE_TEN) + "]) AS v FROM images)",
)

# -- survey -------------------------------------------------------------------------------

define("survey_encode", ENCODED, "SELECT review_id, " + cols(sm.SURVEY_FEATURES) + " FROM encoded")
define(
    "survey_defaults",
    REVIEWS,
    "SELECT review_id, " + ", ".join(f"{v}::DOUBLE AS {n}" for n, v in sm.SURVEY_DEFAULTS.items()) + " FROM reviews",
)
define("survey_augmented_text", AUGMENTED, "SELECT review_id, text FROM augmented")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _case(value: str, labels: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in labels.items()) + f" ELSE {other} END"


def _shown(key: str, kind: str) -> str:
    text = {
        "bool": f"CASE WHEN {key} THEN 'Yes' ELSE 'No' END",
        "likert5": _case(key, sm.LIKERT_LABELS, f"CAST({key} AS VARCHAR)"),
        "durability": _case(key, sm.DURABILITY_LABELS, f"CAST({key} AS VARCHAR)"),
        "pct": f"printf('%.0f%%', {key} * 100.0::DOUBLE)",
        "hours": f"printf('%.1f h', {key})",
        "days": f"CAST({key} AS VARCHAR) || ' days'",
        "count": f"CAST({key} AS VARCHAR) || ' times'",
        "choice": key,
    }[kind]
    return f"CASE WHEN {key} IS NULL THEN '—' ELSE {text} END"


YES_NO = """first_time_buyer compared_alternatives alterations_needed odor_issue support_contact
gift_purchase photo_uploaded""".split()


def _shown_code(name: str) -> str:
    key = name[7:]
    if key == "purchase_channel":
        return _case(name, {0.0: "Online", 1.0: "In-store", 2.0: "Gift"}, f"printf('%.0f', {name})")
    if key == "size_vs_usual":
        return _case(name, {-1.0: "Runs small", 0.0: "True to size", 1.0: "Runs large"}, f"printf('%.1f', {name})")
    if key in dv.SHARE_KEYS:
        return f"CASE WHEN {name} <= 1 THEN printf('%.0f%%', {name} * 100.0::DOUBLE) ELSE printf('%.2f', {name}) END"
    if key in YES_NO:
        return f"CASE WHEN {name} >= 0.5 THEN 'Yes' ELSE 'No' END"
    if key == "days_since_purchase":
        return f"printf('%.0f days', {name})"
    if key == "comfort_hours":
        return f"printf('%.1f h', {name})"
    if key == "worn_before_review":
        return f"printf('%.0f wears', {name})"
    return _case(name, sm.LIKERT_LABELS, f"printf('%.3f', {name})")


QUESTIONS = [(s, k, q, kind) for s, fields in sm.SURVEY_SECTIONS.items() for k, q, kind in fields]
REPORT = ENCODED + ",\nreport AS (" + union(
    f"SELECT review_id, {i}::INTEGER AS ord, {lit(section)} AS section, {lit(question)} AS question, "
    f"{_shown(key, kind)} AS answer, {_shown_code('survey_' + key)} AS signal, 'survey_{key}' AS feature FROM encoded"
    for i, (section, key, question, kind) in enumerate(QUESTIONS, start=1)
) + ")"
define("survey_report", REPORT, "SELECT * FROM report")
define(
    "survey_sections",
    REPORT,
    "SELECT section, count(DISTINCT question) AS questions, count(*) AS answers FROM report GROUP BY section",
)
define(
    "survey_profile",
    ENCODED,
    union(
        f"SELECT review_id, {lit(label)} AS dimension, "
        + rd(f"least(100.0, greatest(0.0, {name} / {cap}::DOUBLE * 100.0::DOUBLE))", "strength")
        + " FROM encoded"
        for name, label, cap in sm.SURVEY_PROFILE
    ),
)
define(
    "survey_likert",
    ANSWERS,
    union(
        f"SELECT review_id, {lit(label)} AS dimension, CAST(coalesce({key}, 3) AS INTEGER) AS score FROM answers"
        for key, label in sm.LIKERT_PROFILE
    ),
)


def funnel(source: str, keep: str) -> str:
    stages = [("Purchase", "100.0::DOUBLE")]
    stages += [
        (stage, f"coalesce(CAST({key} AS DOUBLE), 3.0) / 5.0::DOUBLE * 100.0::DOUBLE")
        for stage, key in (
            ("Fit", "fit_vs_expectation"), ("Quality", "material_vs_price"), ("Logistics", "shipping_satisfaction"),
        )
    ]
    stages.append(("Recommend", "score * 100.0::DOUBLE"))
    return union(
        f"SELECT {keep}, {i}::INTEGER AS ord, '{stage}' AS stage, {rd(value, 'value')} FROM {source}"
        for i, (stage, value) in enumerate(stages, start=1)
    )


define("journey_funnel", SCORED_ANSWERS, funnel("told", "review_id"))
define(
    "journey_by_department",
    SCORED_ANSWERS + """,
averages AS (SELECT "Department Name", count(*) AS n, avg(score) AS score,
  avg(coalesce(fit_vs_expectation, 3)) AS fit_vs_expectation, avg(coalesce(material_vs_price, 3)) AS material_vs_price,
  avg(coalesce(shipping_satisfaction, 3)) AS shipping_satisfaction FROM told GROUP BY 1)""",
    funnel("averages", '"Department Name", n'),
)
FIFTH = "coalesce(CAST({} AS DOUBLE), 3.0) / 5.0::DOUBLE"
REPURCHASE = "coalesce(repurchase_likelihood, 0.5::DOUBLE)"
LINKS = [
    ("Purchase", "Fit", FIFTH.format("fit_vs_expectation"), 0.1),
    ("Purchase", "Quality", FIFTH.format("material_vs_price"), 0.1),
    ("Fit", "Logistics", FIFTH.format("shipping_satisfaction"), 0.1),
    ("Quality", "Intent", REPURCHASE, 0.1),
    ("Logistics", "Intent", REPURCHASE, 0.1),
    ("Intent", "Recommend", "score", 0.05),
]
define(
    "journey_links",
    SCORED_ANSWERS,
    union(
        f"SELECT review_id, '{a}' AS source, '{b}' AS target, {rd(f'greatest({floor}::DOUBLE, {value})', 'value')} FROM told"
        for a, b, value, floor in LINKS
    ),
)
define(
    "intent_gauges",
    SCORED_ANSWERS,
    f"""SELECT review_id, {rd('score * 100', 'recommend_gauge')}, {rd(f'{REPURCHASE} * 100', 'repurchase_gauge')},
  {rd('(1 - coalesce(return_likelihood, 0.2::DOUBLE)) * 100', 'retention_gauge')},
  {rd('coalesce(return_likelihood, 0.15::DOUBLE)', 'return_risk')}, {rd(REPURCHASE, 'repurchase_intent')},
  {rd('coalesce(CAST(fit_vs_expectation AS DOUBLE), 3.0)', 'fit_satisfaction')} FROM told""",
)

# -- learning -----------------------------------------------------------------------------

define(
    "impute_median",
    REVIEWS,
    "SELECT review_id, "
    + ", ".join(f"coalesce({col(c)}, (SELECT median({col(c)}) FROM reviews)) AS {col(c)}" for c in sm.CORE_NUMERIC_COLUMNS)
    + " FROM reviews",
)
SCALED = sm.CORE_NUMERIC_COLUMNS + ALL_TEXT + sm.SURVEY_FEATURES
define(
    "scale_numeric",
    CLEAN_TEXTS + ",\nblock AS MATERIALIZED (SELECT *, "
    + ", ".join(f"{v}::DOUBLE AS {n}" for n, v in sm.SURVEY_DEFAULTS.items())
    + " FROM cleaned JOIN texts USING (review_id)),\nspread AS (SELECT "
    + ", ".join(f"CASE WHEN min({col(c)}) = max({col(c)}) THEN 1.0 ELSE stddev_pop({col(c)}) END AS {col('s ' + c)}" for c in SCALED)
    + " FROM block)",
    "SELECT review_id, " + ", ".join(rd(f"CAST({col(c)} AS DOUBLE) / {col('s ' + c)}", c) for c in SCALED) + " FROM block, spread",
)
define(
    "impute_mode",
    REVIEWS,
    "SELECT review_id, "
    + ", ".join(
        f"coalesce({col(c)}, (SELECT {col(c)} FROM reviews WHERE {col(c)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {col(c)}"
        for c in sm.CATEGORICAL_COLUMNS
    )
    + " FROM reviews",
)
CELLS = ",\ncells AS (" + union(
    f"SELECT review_id, {i} AS place, {lit(c)} AS field, {col(c)} AS value FROM cleaned"
    for i, c in enumerate(sm.CATEGORICAL_COLUMNS)
) + ")"
define(
    "onehot",
    CLEANED + CELLS + """,
known AS (SELECT field, value, CAST(row_number() OVER (ORDER BY place, value) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT place, field, value FROM cells))""",
    "SELECT review_id, field, value, position FROM cells JOIN known USING (field, value)",
)


define(
    "tfidf_weights",
    AUGMENTED + f""",
kept AS (SELECT review_id, list_filter(regexp_extract_all({lower('text')}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({lits(lex.ENGLISH_STOP_WORDS)})) AS k FROM augmented),
terms AS (SELECT review_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS term FROM kept),
tf AS MATERIALIZED (SELECT review_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS documents FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 25000),
raw AS (SELECT review_id, term, tf * (ln((1 + (SELECT count(*) FROM augmented))::DOUBLE / (1 + documents)) + 1) AS w FROM tf JOIN vocabulary USING (term)),
norms AS (SELECT review_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY review_id)""",
    f"SELECT review_id, term, {rd('w / norm', 'weight')} FROM raw JOIN norms USING (review_id)",
)
SPLIT = CLEANED + """,
counts AS (SELECT "Recommended IND" AS y, count(*) AS c FROM cleaned GROUP BY 1),
totals AS (SELECT sum(c)::BIGINT AS n, sum(c)::BIGINT - CAST(ceil(0.2::DOUBLE * sum(c)) AS BIGINT) AS train FROM counts),
shares AS (SELECT y, c, c * train // n AS base, row_number() OVER (ORDER BY c * train % n DESC, y) AS place, train FROM counts, totals),
quotas AS (SELECT y, c - base - CASE WHEN place <= train - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END AS quota FROM shares),
placed AS (SELECT review_id, "Recommended IND", row_number() OVER (PARTITION BY "Recommended IND" ORDER BY md5('42:' || review_id), review_id) AS place FROM cleaned),
parts AS (SELECT review_id, "Recommended IND", CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
  FROM placed JOIN quotas ON y = "Recommended IND")"""
define("stratified_split", SPLIT, "SELECT * FROM parts")
VARYING = sm.CORE_NUMERIC_COLUMNS + ALL_TEXT
define(
    "fit_certificate",
    SPLIT + "," + text_ctes("cleaned", "review_id", '"Title"', '"Review Text"', ALL_TEXT) + f""",
train AS (SELECT * FROM cleaned JOIN texts USING (review_id) SEMI JOIN (SELECT review_id FROM parts WHERE split = 'train') USING (review_id)),
kept AS (SELECT review_id, list_filter(regexp_extract_all({lower(BASE_TEXT)}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({lits(lex.ENGLISH_STOP_WORDS)})) AS k FROM train),
terms AS (SELECT DISTINCT review_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS term FROM kept),
vocabulary AS (SELECT term FROM terms GROUP BY term HAVING count(*) >= 2 LIMIT 25000),
numbers AS (SELECT """ + " + ".join(f"CAST(min({col(c)}) <> max({col(c)}) AS INTEGER)" for c in VARYING) + f""" AS n FROM train),
blocks(block, n) AS (SELECT 'text', count(*) FROM vocabulary UNION ALL SELECT 'numbers', n FROM numbers
  UNION ALL SELECT 'constants', {len(sm.NUMERIC_COLUMNS)} - n FROM numbers UNION ALL SELECT 'bias', 1
  UNION ALL SELECT 'categories', """ + " + ".join(f"count(DISTINCT {col(c)})" for c in sm.CATEGORICAL_COLUMNS) + " FROM train)",
    "SELECT block, n::BIGINT AS columns, n::BIGINT AS settled FROM blocks",
)
define(
    "class_weights",
    CLEANED,
    """SELECT "Recommended IND", n, CAST((SELECT count(*) FROM cleaned) AS DOUBLE) / ((SELECT count(DISTINCT "Recommended IND") FROM cleaned) * n) AS weight
FROM (SELECT "Recommended IND", count(*) AS n FROM cleaned GROUP BY 1)""",
)
define("linear_score", SCORED, f"SELECT review_id, {rd('score', 'score')}, prediction, recommended_label FROM scored")
define(
    "eval_metrics",
    SCORED + """,
steps AS (SELECT score, count(*) FILTER (WHERE "Recommended IND" = 1) AS pos, count(*) FILTER (WHERE "Recommended IND" = 0) AS neg FROM scored GROUP BY score),
area AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc
  FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM steps))""",
    f"""SELECT count(*) AS rows, {rd('avg(CAST(prediction = "Recommended IND" AS INTEGER))', 'accuracy')},
  {rd('coalesce(2.0::DOUBLE * count(*) FILTER (WHERE prediction = 1 AND "Recommended IND" = 1) / nullif(count(*) FILTER (WHERE prediction = 1) + count(*) FILTER (WHERE "Recommended IND" = 1), 0), 0)', 'f1')},
  {rd('(SELECT auc FROM area)', 'roc_auc')} FROM scored""",
)
define(
    "prediction_vs_actual",
    SCORED,
    'SELECT review_id, "Recommended IND", prediction, prediction = "Recommended IND" AS correct FROM scored',
)
FILLED = REVIEWS + """,
cleaned AS (SELECT review_id, coalesce("Title", '') AS "Title", coalesce("Review Text", '') AS "Review Text",
  coalesce("Age", 0.0::DOUBLE) AS "Age", coalesce("Positive Feedback Count", 0.0::DOUBLE) AS "Positive Feedback Count",
  coalesce("Rating", 0.0::DOUBLE) AS "Rating" FROM reviews),""" + text_ctes(
    "cleaned", "review_id", '"Title"', '"Review Text"', ALL_TEXT
)
define(
    "batch_score_linear",
    FILLED + ",\nfeatured AS (SELECT * FROM cleaned JOIN texts USING (review_id))," + scored_cte("featured"),
    f"SELECT reviews.*, prediction, {rd('score', 'score')}, recommended_label FROM reviews JOIN scored USING (review_id)",
)
define(
    "rating_sensitivity",
    FILLED
    + """,
featured AS (SELECT cleaned.* EXCLUDE ("Rating"), texts.* EXCLUDE (review_id), CAST(r AS DOUBLE) AS "Rating"
  FROM cleaned JOIN texts USING (review_id) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS stars(r)),"""
    + scored_cte("featured"),
    f'SELECT review_id, "Rating", {rd("score", "score")} FROM scored',
)

# -- explanation --------------------------------------------------------------------------

BY_SIZE = "ORDER BY abs(value) DESC, ord"
define(
    "feature_breakdown",
    LONG,
    f"""SELECT review_id, grp AS "group", feature, ord::INTEGER AS ord,
  CAST(row_number() OVER (PARTITION BY review_id, grp {BY_SIZE}) AS INTEGER) AS rank, value FROM signals""",
)
define(
    "top_signals",
    LONG,
    f"""SELECT * FROM (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id {BY_SIZE}) AS INTEGER) AS rank,
  grp AS "group", feature, spoken AS label, value FROM signals WHERE feature <> 'img_has_image') WHERE rank <= 3""",
)
RADAR = " ".join(f"WHEN {lit(group)} THEN {lit(label)}" for group, _, label, _ in sm.FEATURE_GROUPS)
define(
    "modality_strength",
    LONG,
    f"""SELECT review_id, grp AS "group", CASE grp {RADAR} END AS label, {rd('avg(abs(value))', 'strength')}
FROM signals GROUP BY review_id, grp""",
)
define(
    "modality_drivers",
    LONG,
    f"""SELECT review_id, grp AS modality, rank, words AS feature, value AS impact FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY review_id, grp {BY_SIZE}) AS INTEGER) AS rank FROM signals) WHERE rank <= 4""",
)
UNIT_PARTS = """likelihood loyalty sensitivity match importance formality difficulty buyer alternatives worn gift
odor contact alterations photo channel""".split()
NORM = (
    "CASE WHEN contains(feature, 'char_count') OR contains(feature, 'word_count') OR contains(feature, 'sentence_len') THEN value / 400.0::DOUBLE "
    "WHEN contains(feature, 'days_since') THEN value / 60.0::DOUBLE WHEN contains(feature, 'comfort_hours') THEN value / 12.0::DOUBLE "
    "WHEN modality = 'survey' AND (" + " OR ".join(f"contains(feature, '{p}')" for p in UNIT_PARTS) + ") THEN value "
    "WHEN modality = 'survey' THEN value / 5.0::DOUBLE WHEN modality = 'img' OR abs(value) <= 1 THEN abs(value) ELSE abs(value) / 10.0::DOUBLE END"
)
define(
    "feature_matrix",
    LONG
    + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id, modality {BY_SIZE}) AS rank,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, {NORM})) AS norm FROM signals),
shown AS (SELECT r.* FROM ranked r JOIN frame f USING (review_id) WHERE rank <= 6 AND norm > 0.02::DOUBLE AND (modality <> 'img' OR f.img_has_image > 0))""",
    "SELECT review_id, short AS feature, "
    + ", ".join(f"max(norm) FILTER (WHERE modality = '{m}') AS {m}" for m in ("nlp", "vis", "img", "survey"))
    + " FROM shown GROUP BY review_id, short",
)

# -- business rules -----------------------------------------------------------------------

RETURNS = "coalesce(return_likelihood, 0.2::DOUBLE)"
define(
    "review_emoji",
    SCORED_ANSWERS,
    f"""SELECT review_id, array_to_string(list_filter([
    CASE WHEN prediction = 1 AND score >= 0.8 THEN '✅ Strong recommend signal' WHEN score >= 0.5 THEN '🤔 Mixed recommend signal' ELSE '⚠️ Low recommend signal' END,
    CASE WHEN "Rating" >= 4 THEN '⭐ High rating' WHEN "Rating" <= 2.5 THEN '⭐ Low rating' END,
    CASE WHEN {REPURCHASE} >= 0.7::DOUBLE THEN '🔁 High repurchase intent' WHEN {REPURCHASE} <= 0.35::DOUBLE THEN '🧍 Weak repurchase intent' END,
    CASE WHEN {RETURNS} >= 0.55::DOUBLE THEN '↩️ High return risk' WHEN {RETURNS} <= 0.25::DOUBLE THEN '📦 Low return risk' END,
    CASE WHEN "Positive Feedback Count" >= 8 THEN '👍 Helpful-vote traction' END,
    CASE WHEN photo_uploaded THEN '📷 Photo-verified review' END], lambda t: t IS NOT NULL)[1:5], ' | ') AS emoji_summary FROM told""",
)
define(
    "review_insights",
    LONG + "," + scored_cte("frame") + f""",
tops AS (SELECT review_id, string_agg(trim(split_part(grp, '(', 1)) || ': ' || spoken || '=' || printf('%.2f', value), ', ' ORDER BY rank) AS terms
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id {BY_SIZE}) AS rank FROM signals WHERE feature <> 'img_has_image') WHERE rank <= 3 GROUP BY review_id),
told AS (SELECT s.review_id, s.score, s.prediction, s."Rating", t.terms, a.return_likelihood, a.repurchase_likelihood,
  coalesce(a.fit_vs_expectation, 3) AS fit, coalesce(a.material_vs_price, 3) AS material, coalesce(a.shipping_satisfaction, 3) AS shipping
  FROM scored s JOIN tops t USING (review_id) LEFT JOIN answers a USING (review_id)),
lists AS (SELECT review_id, list_filter([
    'Model outcome: ' || CASE WHEN prediction = 1 THEN 'recommended' ELSE 'not recommended' END || ' with ' || printf('%.1f%%', score * 100.0::DOUBLE) || ' confidence.',
    CASE WHEN "Rating" >= 4 AND score < 0.65 THEN 'High rating but weaker model confidence suggests hidden friction in review language.'
         WHEN "Rating" <= 2.5 AND score >= 0.55 THEN 'Low star rating with moderate confidence indicates mixed signals worth manual review.' END,
    CASE WHEN {RETURNS} >= 0.55::DOUBLE THEN 'Risk watch: return likelihood is high; prioritize fit clarity and pre-purchase guidance.' END,
    CASE WHEN {REPURCHASE} >= 0.7::DOUBLE THEN 'Growth signal: repurchase intent is strong; candidate for loyalty or upsell campaigns.' END,
    CASE WHEN fit <= 2.5 OR material <= 2.5 THEN 'Product signal: fit/material perception is weak; review sizing content and fabric expectations.' END,
    CASE WHEN shipping <= 2.5 THEN 'Operations signal: shipping experience is below target; investigate fulfillment/last-mile issues.' END,
    'Strongest measured signals: ' || terms || '.',
    CASE WHEN prediction = 1 AND score >= 0.75 THEN 'Recommended action: amplify this review in merchandising and social proof placements.'
         WHEN prediction = 0 AND score >= 0.65 THEN 'Recommended action: route to quality CX queue and trigger root-cause follow-up.'
         ELSE 'Recommended action: monitor additional reviews before making category-level changes.' END], lambda t: t IS NOT NULL)[1:5] AS items FROM told)""",
    "SELECT review_id, CAST(unnest(range(len(items))) AS INTEGER) AS place, unnest(items) AS insight FROM lists",
)
BATCH_TEXTS = """concat_ws(' | ',
    CASE WHEN prediction = 1 AND score >= 0.8 THEN '✅ Strong buy signal' WHEN score >= 0.5 THEN '🤔 Mixed signal' ELSE '⚠️ Risk signal' END,
    CASE WHEN "Rating" >= 4 THEN '⭐ High rating' WHEN "Rating" > 0 AND "Rating" <= 2.5 THEN '⭐ Low rating' END,
    CASE WHEN "Positive Feedback Count" >= 8 THEN '👍 Helpful traction' END) AS business_emoji,
  CASE WHEN prediction = 1 AND score >= 0.8 THEN 'Promote in high-conversion slots; confidence and sentiment are aligned.'
    WHEN prediction = 0 AND score >= 0.65 THEN 'Prioritize remediation workflow; strong non-recommend pattern.'
    WHEN "Rating" >= 4 AND score < 0.6 THEN 'Star rating is high but text signal is mixed; validate review consistency.'
    ELSE 'Monitor and collect more evidence before large-scale merchandising changes.' END AS local_ai_insight"""
define("batch_signals", SCORED, f"SELECT review_id, recommended_label, {BATCH_TEXTS} FROM scored")
define(
    "batch_preview",
    SCORED,
    f"SELECT review_id, recommended_label, {rd('score', 'score')}, {BATCH_TEXTS} FROM scored ORDER BY review_id LIMIT 20",
)
define("verdicts", SCORED, "SELECT review_id, CASE WHEN prediction = 1 THEN 'Recommended' ELSE 'Not recommended' END AS verdict FROM scored")
define(
    "predict_and_explain",
    LONG + "," + scored_cte("frame"),
    f"""SELECT review_id, {rd('score', 'score')}, prediction, recommended_label, grp AS "group", feature, value
FROM signals JOIN scored USING (review_id)""",
)

# -- segments -----------------------------------------------------------------------------

RATE = rd('avg("Recommended IND")', "recommend")
define(
    "corpus_kpis",
    CLEANED,
    f"""SELECT count(*) AS reviews, {rd('avg("Recommended IND")', 'recommend_rate')}, {rd('avg("Rating")', 'avg_rating')} FROM cleaned""",
)
define(
    "catalog_hierarchy",
    CLEANED,
    f"""SELECT "Division Name", "Department Name", "Class Name", count("Recommended IND") AS reviews, {RATE} FROM cleaned GROUP BY 1, 2, 3""",
)
define(
    "catalog_rollup",
    CLEANED,
    f"""SELECT "Division Name", "Department Name", "Class Name",
  CAST(3 - grouping("Division Name") - grouping("Department Name") - grouping("Class Name") AS INTEGER) AS level,
  count("Recommended IND") AS reviews, {RATE} FROM cleaned GROUP BY ROLLUP ("Division Name", "Department Name", "Class Name")""",
)
define(
    "department_volume",
    CLEANED,
    f"""SELECT "Department Name", count("Recommended IND") AS reviews, {RATE} FROM cleaned GROUP BY 1""",
)
BINNED = CLEANED + """,
binned AS (SELECT *, CASE WHEN "Age" <= 25 THEN '<25' WHEN "Age" <= 35 THEN '25-35' WHEN "Age" <= 45 THEN '35-45'
  WHEN "Age" <= 55 THEN '45-55' ELSE '55+' END AS age_bin FROM cleaned WHERE "Age" > 0 AND "Age" <= 100)"""
define("age_rating_heatmap", BINNED, f'SELECT age_bin, "Rating", {RATE} FROM binned GROUP BY 1, 2')
define(
    "age_rating_pivot",
    BINNED,
    "SELECT age_bin, "
    + ", ".join(rd(f'avg("Recommended IND") FILTER (WHERE "Rating" = {r})', f"rating_{r}") for r in range(1, 6))
    + " FROM binned GROUP BY 1",
)
define(
    "department_landscape",
    CLEANED,
    f"""SELECT "Department Name", {rd('avg("Rating")', 'avg_rating')}, {rd('avg("Age")', 'avg_age')}, {RATE},
  count("Recommended IND") AS n FROM cleaned GROUP BY 1 HAVING avg("Age") > 0 ORDER BY 1 LIMIT 12""",
)
define(
    "dept_rating_box",
    CLEANED + """,
top AS (SELECT "Department Name" FROM cleaned GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
kept AS (SELECT * FROM cleaned WHERE "Department Name" IN (SELECT "Department Name" FROM top)),
boxes AS (SELECT "Department Name", "Recommended IND", quantile_cont("Rating", 0.25) AS q1, quantile_cont("Rating", 0.5) AS median,
  quantile_cont("Rating", 0.75) AS q3 FROM kept GROUP BY 1, 2)""",
    """SELECT "Department Name", "Recommended IND", q1, median, q3, count(*) AS n, min("Rating") AS lowest, max("Rating") AS highest,
  count(*) FILTER (WHERE "Rating" < q1 - (q3 - q1) * 1.5 OR "Rating" > q3 + (q3 - q1) * 1.5) AS outliers
FROM kept JOIN boxes USING ("Department Name", "Recommended IND") GROUP BY ALL""",
)


def drawn(source: str, size: int, seed: int) -> str:
    return f"(SELECT * FROM {source} ORDER BY md5('{seed}:' || review_id), review_id LIMIT {size})"


define(
    "market_sample",
    CLEANED,
    f"""SELECT review_id, "Age", "Rating", "Positive Feedback Count", "Recommended IND" FROM {drawn('cleaned', 2500, 42)} WHERE "Age" > 0""",
)
define(
    "batch_sample",
    SCORED,
    f"""SELECT review_id, "Rating", {rd('score', 'score')}, prediction, recommended_label FROM {drawn('scored', 500, 0)}""",
)
define("random_review", CLEANED, f"SELECT * FROM {drawn('cleaned', 1, 7)}")
define(
    "batch_kpis",
    SCORED,
    f"SELECT count(*) AS rows, {rd('avg(CAST(prediction = 1 AS INTEGER))', 'recommend_rate')}, {rd('avg(score)', 'avg_score')} FROM scored",
)
define(
    "score_histogram",
    SCORED,
    "SELECT recommended_label, CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1, 2",
)
define("category_options", CLEANED + CELLS, "SELECT DISTINCT field, value AS option FROM cells")


def all_sql() -> dict[str, str]:
    return dict(SQL)
