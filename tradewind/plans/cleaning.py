"""Cleaning queries over the raw trade log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, moment
from ..operators import cleaning as C
from ..sources.tables import RAW, TRADES
from .registry import query

# Fixed values of the cleaning rules on these tables.
BAD_BRAND = "brand#13"
CUTOFF = "2001-06-01"
SYMBOLS = {"1": "c1", "2": "c2", "3": "c3", "4": "c4", "5": "c5"}
RTOL, ATOL = 1e-9, 1e-10
ADDRESS = r"\A0x[0-9a-f]{40}\z"
BURNT = ("0x" + "0" * 40, "0x" + "0" * 36 + "dead")
#: Parts of this size or more have traits that count for a candidate.
LEAST_SIZE = 3
RULES = [
    "exact_extra", "bad_id", "wrong_contract", "bad_entity", "bad_date", "outside_cutoff",
    "not_single_sale", "bad_party", "bad_price", "bad_currency", "amount_mismatch", "ambiguous",
]
COPY_COLUMNS = [
    "source_row", "market", "entity_text", "us", "price", "amount_raw", "qty", "tx", "trade_id", "buyer", "seller",
    "evt", "status", "ship", "brand", "symbol", "contract",
]
PAIR_WINDOW_DAYS = 30

FLAGS = RAW + """,
marked AS (
  SELECT *,
    row_number() OVER (PARTITION BY source_row ORDER BY line_no) > 1 AS exact_extra,
    count(*) OVER (PARTITION BY trade_id) > 1 AS shared_id,
    count(*) OVER (PARTITION BY tx, entity) > 1 AS ambiguous,
    try_cast(entity_text AS DOUBLE) AS token
  FROM raw),
flags AS (
  SELECT *, (trade_id IS NULL OR trim(trade_id) = '' OR shared_id) AND NOT exact_extra AS bad_id,
    lower(brand) = 'brand#13' AS wrong_contract,
    token IS NULL OR token < 0 OR token <> floor(token) AS bad_entity,
    ts IS NULL OR trade_date IS NULL OR CAST(ts AS DATE) <> trade_date AS bad_date,
    ts >= TIMESTAMP '2001-06-01' AS outside_cutoff,
    (evt = 'R' AND status = 'F') OR qty IS NULL OR qty > 49 AS not_single_sale,
    NOT (regexp_full_match(lower(buyer_address), '0x[0-9a-f]{40}') AND regexp_full_match(lower(seller_address), '0x[0-9a-f]{40}'))
      OR lower(buyer_address) IN (concat('0x', repeat('0', 40)), concat('0x', repeat('0', 36), 'dead'))
      OR lower(seller_address) IN (concat('0x', repeat('0', 40)), concat('0x', repeat('0', 36), 'dead'))
      OR lower(buyer_address) = lower(seller_address) AS bad_party,
    price IS NULL OR isnan(price) OR isinf(price) OR price <= 0 AS bad_price,
    NOT (symbol IN ('1', '2', '3', '4', '5') AND contract = concat('c', symbol)) AS bad_currency,
    coalesce(symbol IN ('1', '2', '3', '4', '5') AND contract = concat('c', symbol), false) AND price IS NOT NULL AND NOT isnan(price)
      AND NOT coalesce(NOT isinf(price * qty) AND abs(amount_raw - price * qty) <= 1e-10 + 1e-9 * abs(price * qty), false) AS amount_mismatch
  FROM marked)"""

CLEAN = FLAGS + """,
ledger AS (
  SELECT *, CASE WHEN exact_extra THEN 1 WHEN bad_id THEN 2 WHEN wrong_contract THEN 3 WHEN bad_entity THEN 4 WHEN bad_date THEN 5
     WHEN outside_cutoff THEN 6 WHEN not_single_sale THEN 7 WHEN bad_party THEN 8 WHEN bad_price THEN 9 WHEN bad_currency THEN 10
     WHEN amount_mismatch THEN 11 WHEN ambiguous THEN 12 ELSE 13 END AS step,
     NOT (exact_extra OR bad_id OR wrong_contract OR bad_entity OR bad_date OR outside_cutoff OR not_single_sale OR bad_party
          OR bad_price OR bad_currency OR amount_mismatch OR ambiguous) AS base_clean
  FROM flags)"""


def rule_conditions() -> list[tuple[str, F.Column]]:
    token, price, qty = F.col("entity_text").try_cast("double"), F.col("price"), F.col("qty")
    implied = price * qty
    buyer, seller = F.lower(F.coalesce("buyer_address", F.lit(""))), F.lower(F.coalesce("seller_address", F.lit("")))
    mapped = any_of([(F.col("symbol") == s) & (F.col("contract") == c) for s, c in SYMBOLS.items()])
    close = (F.abs(implied) < float("inf")) & (F.abs(F.col("amount_raw") - implied) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(implied))
    conditions = {
        "exact_extra": F.col("exact_extra"),
        "bad_id": F.col("bad_id"),
        "wrong_contract": F.lower("brand") == BAD_BRAND,
        "bad_entity": token.isNull() | (token < 0) | (token != F.floor(token)),
        "bad_date": F.col("ts").isNull() | F.col("trade_date").isNull() | (F.to_date("ts") != F.col("trade_date")),
        "outside_cutoff": F.col("ts") >= moment(CUTOFF),
        "not_single_sale": ((F.col("evt") == "R") & (F.col("status") == "F")) | qty.isNull() | (qty > 49),
        "bad_party": ~(buyer.rlike(ADDRESS) & seller.rlike(ADDRESS)) | buyer.isin(*BURNT) | seller.isin(*BURNT) | (buyer == seller),
        "bad_price": price.isNull() | F.isnan(price) | (F.abs(price) == float("inf")) | (price <= 0),
        "bad_currency": ~mapped,
        # Only a supported currency and a present price can disagree with the raw amount.
        "amount_mismatch": F.coalesce(mapped, F.lit(False)) & price.isNotNull() & ~F.isnan(price) & ~F.coalesce(close, F.lit(False)),
        "ambiguous": F.col("ambiguous"),
    }
    return [(r, conditions[r]) for r in RULES]


def flagged(t, raw: DataFrame | None = None) -> DataFrame:
    """Raw log with the flags that depend on other rows, attached in one join on the line."""
    raw = t.trades_raw if raw is None else raw
    rows = C.attach_flags(raw, "line_no", {
        "exact_extra": C.exact_extra_lines(t.trades_raw, COPY_COLUMNS, "line_no"),
        "shared_id": C.shared_key_lines(t.trades_raw, ["trade_id"], "line_no"),
        "ambiguous": C.shared_key_lines(t.trades_raw, ["tx", "entity"], "line_no"),
    })
    return rows.withColumn("bad_id", C.repeated_id("trade_id", "shared_id", "exact_extra"))


def clean_ledger(t) -> DataFrame:
    """Raw log with all rule flags, the first rule that excludes each row and ``base_clean``."""
    # What a row decides alone is decided before the join, which then carries flags instead of addresses.
    alone = {f"_{n}": c for n, c in rule_conditions_local()}
    rows = flagged(t, t.trades_raw.withColumns(alone))
    rules = [(n, F.col(f"_{n}") if f"_{n}" in alone else F.col(n)) for n in RULES]
    return C.waterfall(rows, rules).drop(*alone)


def ledger_stage(t) -> DataFrame:
    return t.stage("full_ledger", lambda: clean_ledger(t).select(
        "line_no", "source_row", "market", "entity", "ts", "us", "price", "tx", "buyer", "seller", "symbol", "qty", "order_id", "line", "step", "first_exclusion", "base_clean",
        *[f"flag_{r}" for r in RULES],
    ))


def one_flag(rule):
    return lambda t: t.trades_raw.select("line_no", F.coalesce(dict(rule_conditions_local())[rule], F.lit(False)).alias("flag"))


def rule_conditions_local():
    return [(n, c) for n, c in rule_conditions() if n not in ("exact_extra", "bad_id", "ambiguous")]


@query("cln1", f"WITH {FLAGS} SELECT line_no, exact_extra AS flag FROM flags")
def cln1(t):
    return C.flag_exact_extras(t.trades_raw, COPY_COLUMNS, "line_no").select("line_no", F.col("exact_extra").alias("flag"))


@query("cln2", f"WITH {FLAGS} SELECT line_no, bad_id AS flag FROM flags")
def cln2(t):
    raw = t.trades_raw
    rows = C.attach_flags(raw, "line_no", {"extra": C.exact_extra_lines(raw, COPY_COLUMNS, "line_no"), "shared": C.shared_key_lines(raw, ["trade_id"], "line_no")})
    return rows.select("line_no", C.repeated_id("trade_id", "shared", "extra").alias("flag"))


for _id, _rule in [("cln3", "wrong_contract"), ("cln4", "bad_entity"), ("cln5", "bad_date"), ("cln6", "outside_cutoff"),
                   ("cln7", "not_single_sale"), ("cln8", "bad_party"), ("cln9", "bad_price"), ("cln10", "bad_currency"),
                   ("cln11", "amount_mismatch")]:
    query(_id, f"WITH {FLAGS} SELECT line_no, coalesce({_rule}, false) AS flag FROM flags")(one_flag(_rule))


@query("cln12", f"WITH {FLAGS} SELECT line_no, ambiguous AS flag FROM flags")
def cln12(t):
    return C.flag_shared(t.trades_raw, ["tx", "entity"], "line_no", "flag").select("line_no", "flag")


def _flow_sql() -> str:
    parts = [
        f"SELECT CAST({i} AS BIGINT) AS step, '{r}' AS rule, count(*) FILTER (WHERE {r}) AS flagged, count(*) FILTER (WHERE step = {i}) AS excluded, "
        f"count(*) FILTER (WHERE step > {i}) AS remaining_rows, count(DISTINCT entity) FILTER (WHERE step > {i}) AS remaining_entities FROM ledger"
        for i, r in enumerate(RULES, 1)
    ]
    return f"WITH {CLEAN} " + " UNION ALL ".join(parts)


@query("cln13", _flow_sql())
def cln13(t):
    return C.waterfall_flow(clean_ledger(t), RULES, "entity")


@query("cln13_ledger", f"WITH {CLEAN} SELECT line_no, CAST(step AS BIGINT) AS step, base_clean FROM ledger")
def cln13_ledger(t):
    return clean_ledger(t).select("line_no", F.col("step").cast("bigint").alias("step"), "base_clean")


MULTI = """multi AS (SELECT tx FROM raw GROUP BY tx HAVING count(DISTINCT concat(market, '/', entity)) > 1)"""
PAIRS = """lagged AS (
  SELECT *, lag(us) OVER w AS pu, lag(buyer) OVER w AS pb, lag(seller) OVER w AS ps FROM ledger WHERE base_clean
  WINDOW w AS (PARTITION BY entity ORDER BY us, order_id, line_no)),
pairs AS (
  SELECT *, coalesce(us > pu AND us - pu <= 30 * 86400000000 AND buyer = ps AND seller = pb, false) AS reverse_pair FROM lagged)"""


def with_multi(df):
    asset = df.withColumn("_asset", F.concat_ws("/", "market", "entity"))
    return C.flag_shared(asset, ["tx"], "line_no", "multi", distinct="_asset").drop("_asset")


def with_pairs(clean):
    return C.flag_reverse_pairs(clean, "entity", "us", ["order_id", "line_no"], "buyer", "seller", PAIR_WINDOW_DAYS * 86_400_000_000)


@query("cln14", f"WITH {RAW}, {MULTI} SELECT line_no, tx IN (SELECT tx FROM multi) AS multi FROM raw")
def cln14(t):
    return with_multi(t.trades_raw).select("line_no", "multi")


@query("cln15", f"WITH {CLEAN}, {PAIRS} SELECT line_no, reverse_pair FROM pairs")
def cln15(t):
    return with_pairs(ledger_stage(t).filter("base_clean")).select("line_no", "reverse_pair")


@query("cln16", f"""WITH {CLEAN}, {MULTI}, {PAIRS}
SELECT line_no, base_clean, coalesce(base_clean AND tx NOT IN (SELECT tx FROM multi) AND NOT p.reverse_pair, false) AS strict_clean
FROM ledger l LEFT JOIN (SELECT line_no AS ln, reverse_pair FROM pairs) p ON p.ln = l.line_no""")
def cln16(t):
    rows = with_multi(ledger_stage(t))
    pairs = with_pairs(ledger_stage(t).filter("base_clean")).select("line_no", "reverse_pair")
    strict = F.col("base_clean") & ~F.col("multi") & ~F.col("reverse_pair")
    return rows.join(pairs, "line_no", "left").select("line_no", "base_clean", F.coalesce(strict, F.lit(False)).alias("strict_clean"))


@query("cln17", f"""WITH {CLEAN},
pool AS (
  SELECT line_no, entity, word1, count(*) OVER w AS pn, count(DISTINCT entity) OVER w AS pe FROM ledger WHERE base_clean
  WINDOW w AS (PARTITION BY market ORDER BY us RANGE BETWEEN 1728000000000 PRECEDING AND 1 PRECEDING)),
j AS (SELECT l.line_no, l.base_clean, coalesce(p.pn, 0) AS prior_n, coalesce(p.pe, 0) AS prior_entities,
   l.entity IN (SELECT p_partkey FROM part WHERE p_size >= 3) AS traits, l.entity IN (SELECT vec_id FROM embeddings) AS asset_ready FROM ledger l LEFT JOIN pool p ON p.line_no = l.line_no)
SELECT line_no, prior_n, prior_entities, base_clean AND prior_n >= 20 AND prior_entities >= 10 AND traits AS candidate,
  base_clean AND prior_n >= 20 AND prior_entities >= 10 AND traits AND asset_ready AS runnable FROM j""")
def cln17(t):
    from ..operators import temporal
    ledger = ledger_stage(t)
    clean = ledger.filter("base_clean")
    support = temporal.past_only_support(clean, "market", "us", "entity").withColumn("base_clean", F.lit(True))
    ready = t.labels_by_entity.select("entity").distinct().withColumn("ready", F.lit(True))
    traits = t.read("part").where(F.col("p_size") >= LEAST_SIZE).select(F.col("p_partkey").alias("entity")).distinct().withColumn("traits", F.lit(True))
    rows = ledger.join(support, ["market", "us", "base_clean"], "left").join(ready, "entity", "left").join(traits, "entity", "left")
    rows = rows.withColumn("prior_n", F.coalesce("prior_n", F.lit(0))).withColumn("prior_entities", F.coalesce("prior_entities", F.lit(0)))
    candidate = F.col("base_clean") & (F.col("prior_n") >= 20) & (F.col("prior_entities") >= 10) & F.coalesce("traits", F.lit(False))
    return rows.select("line_no", "prior_n", "prior_entities", candidate.alias("candidate"), (candidate & F.coalesce("ready", F.lit(False))).alias("runnable"))


# Fixed pattern of texts that must never be published: keys, tokens and private-key headers.
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"


@query("cln18", """
SELECT d.doc_id, concat_ws(',', CASE WHEN trim(text) = '' OR text IS NULL THEN 'empty' END,
  CASE WHEN l.doc_id IS NULL THEN 'no_label' END, CASE WHEN length(text) < 20 THEN 'short' END,
  CASE WHEN length(text) <> n_chars THEN 'size_mismatch' END) AS issues,
  NOT (trim(text) = '' OR text IS NULL OR length(text) < 20 OR length(text) <> n_chars OR l.doc_id IS NULL) AS ready
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def cln18(t):
    """Readiness ledger of payloads with the list of failed checks."""
    known = t.read("labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = t.read("documents").join(known, "doc_id", "left")
    issues = C.issue_list({
        "empty": F.col("text").isNull() | (F.trim("text") == ""),
        "short": F.length("text") < 20,
        "size_mismatch": F.length("text") != F.col("n_chars"),
        "no_label": F.col("known").isNull(),
    })
    return rows.select("doc_id", issues.alias("issues"), (issues == "").alias("ready"))


@query("cln19", """
SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def cln19(t):
    """Groups of identical payloads: counted, never listed."""
    return (
        t.read("documents").groupBy(F.sha2("text", 256).alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .filter("copies > 1")
    )


@query("cln20", f"SELECT doc_id, regexp_matches(text, '{SECRET}') AS has_secret FROM documents")
def cln20(t):
    return t.read("documents").select("doc_id", F.col("text").rlike(SECRET).alias("has_secret"))


@query("cln21", """
SELECT doc_id AS id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT p_partkey, 'extra' FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)""")
def cln21(t):
    """Documents without labels, and parts without documents, as two inventory differences."""
    docs = t.read("documents").select(F.col("doc_id").alias("id"))
    labelled = t.read("labels").select(F.col("doc_id").alias("id"))
    parts = t.read("part").select(F.col("p_partkey").alias("id"))
    missing = C.inventory_diff(docs, labelled, "id").filter("kind = 'missing'")
    extra = C.inventory_diff(docs, parts, "id").filter("kind = 'extra'")
    return missing.unionByName(extra)


@query("cln22", """
WITH a AS (SELECT p_partkey AS id, p_brand AS brand, CAST(p_size // 10 AS VARCHAR) AS band, split_part(p_name, ' ', 1) AS word FROM part),
b AS (SELECT id + 3 AS id, CASE WHEN id % 7 = 0 THEN ' None ' ELSE brand END AS brand, CASE WHEN id % 5 = 0 THEN NULL ELSE band END AS band, word FROM
   (SELECT p_partkey - 3 AS id, p_brand AS brand, CAST(p_size // 10 AS VARCHAR) AS band, split_part(p_name, ' ', 1) AS word FROM part) x),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS ai, b.id AS bi, a.brand AS ab, b.brand AS bb, a.band AS aband, b.band AS bband, a.word AS aw, b.word AS bw
      FROM a FULL JOIN (SELECT * FROM b WHERE id % 11 <> 0) b ON a.id = b.id)
SELECT id, 'missing_right' AS "column", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM j WHERE bi IS NULL
UNION ALL SELECT id, 'missing_left', NULL, NULL FROM j WHERE ai IS NULL
UNION ALL SELECT id, 'brand', ab, bb FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND ab IS DISTINCT FROM bb
UNION ALL SELECT id, 'band', aband, bband FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND aband IS DISTINCT FROM bband
UNION ALL SELECT id, 'word', aw, bw FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND aw IS DISTINCT FROM bw""")
def cln22(t):
    """Cell-level difference of a trait table and a second source with altered and absent rows."""
    a = t.read("part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"),
        F.expr("cast(p_size div 10 as string)").alias("band"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"),
    )
    shifted = F.col("id") - 3
    b = a.select(
        "id", F.when(shifted % 7 == 0, F.lit(" None ")).otherwise(F.col("brand")).alias("brand"),
        F.when(shifted % 5 != 0, F.col("band")).alias("band"), "word",
    ).filter(F.col("id") % 11 != 0)
    return C.cell_diff(a, b, "id", ["brand", "band", "word"])
