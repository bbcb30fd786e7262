"""The registered queries in SQL, written independently of the DataFrame code.

Common table expressions are shared: ``plain`` is the prediction table before
post-processing, ``signals`` the finished one, ``raw`` what the dirty cells must
become, ``gaz`` the gazetteer.
"""

from __future__ import annotations

from checks.adapter import weights
from reliefsignals.fixed_values import (
    DEFAULT_LABELS,
    INFO_ANNOUNCEMENT,
    INFO_CONTACT,
    INFO_MISSING,
    INFO_REQUEST,
    LABEL_NAMES,
    THRESHOLDS,
)

L = DEFAULT_LABELS
PREDS = [f"pred_{x}" for x in L]
PROBS = [f"prob_{x}" for x in L]


def lit(number: float) -> str:
    return f"CAST('{number!r}' AS DOUBLE)"


def each(template: str, sep: str = ", ") -> str:
    """The template once per label; ``{x}`` label, ``{i}`` position, ``{n}`` name, ``{t}`` threshold."""
    return sep.join(template.format(x=x, i=i, n=LABEL_NAMES[x], t=lit(THRESHOLDS[x])) for i, x in enumerate(L))


def rule(text: str) -> str:
    """The information rule over a text expression."""
    m, r, c, a = (
        f"regexp_matches({text}, '{p}', 'i')" for p in (INFO_MISSING, INFO_REQUEST, INFO_CONTACT, INFO_ANNOUNCEMENT)
    )
    return f"(({m} AND {r}) OR ({m} AND {c}) OR ({r} AND {c}) OR {a})"


BASE = f"""
base AS (
  SELECT event_id AS e, user_id AS u, ts, value, n_name, r_name,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey),
scored AS (
  SELECT e, ts, CAST(e AS VARCHAR) AS id, 'raw ' || e AS tweet,
    CASE e % 8 WHEN 0 THEN 'haber alamıyoruz, bilen var mı'
               WHEN 1 THEN 'ulaşılamıyor, telefon 05551234567'
               WHEN 2 THEN 'duyan bilen irtibat kursun'
               WHEN 3 THEN 'duyuru: yardım dağıtım noktası'
               WHEN 4 THEN 'çadıra ihtiyaç var'
               WHEN 5 THEN 'su ve gıda lazım'
               WHEN 6 THEN NULL ELSE '' END AS tweet_clean,
    ts + INTERVAL 3 HOUR AS local,
    strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS date,
    strftime(ts + INTERVAL 3 HOUR, '%H:%M:%S') AS time,
    strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:00:00') AS hour,
    CASE WHEN e % 17 = 0 THEN '' ELSE r_name END AS province,
    CASE WHEN e % 13 = 0 THEN '' ELSE n_name END AS district,
    CASE WHEN e % 10 = 0 THEN '' ELSE 'N' || (u % 7) END AS neighborhood,
    floor(value / CAST(50 AS DOUBLE)) AS urgency_score,
    {each("((k * (2 * {i} + 3) + e * ({i} + 1)) % 100) / CAST(100 AS DOUBLE) AS prob_{x}")}
  FROM base),
plain AS (
  SELECT *, {each("CAST(prob_{x} >= {t} AS INTEGER) AS pred_{x}")} FROM scored)"""

SIGNALS = f"""{BASE},
ruled AS (
  SELECT * REPLACE (CAST(CASE WHEN added THEN 1 ELSE pred_bilgi_paylasimi END AS BIGINT) AS pred_bilgi_paylasimi)
  FROM (SELECT *, pred_bilgi_paylasimi = 0 AND prob_bilgi_paylasimi >= {lit(0.2)}
                  AND {rule("lower(coalesce(tweet_clean, ''))")} AS added FROM plain)),
signals AS (
  SELECT *, CAST(added AS INTEGER) AS postprocess_info_v1_added,
    CAST({" + ".join(PREDS)} AS BIGINT) AS pred_label_count,
    CAST({" + ".join(PREDS)} > 0 AS INTEGER) AS pred_any_need
  FROM ruled)"""

CREATED = """CASE WHEN e % 7 IN (0, 1, 2, 4) THEN date_trunc('second', ts)
       WHEN e % 7 = 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END"""

RAW = f"""{BASE},
cleaned AS (
  SELECT * EXCLUDE (date, time) REPLACE (
      CASE e % 11 WHEN 0 THEN province WHEN 4 THEN 'Kahramanmaraş' WHEN 5 THEN 'Şanlıurfa'
                  WHEN 6 THEN 'Diyarbakır' WHEN 7 THEN chr(195) || ' tek'
                  WHEN 8 THEN 'Gaziantep ' || chr(65533) WHEN 9 THEN 'Adıyaman' ELSE '' END AS province,
      CASE WHEN e % 3 = 2 THEN '' ELSE district END AS district,
      CASE WHEN e % 6 IN (0, 1) THEN urgency_score ELSE CAST(0 AS DOUBLE) END AS urgency_score,
      CAST(CASE WHEN e % 5 IN (0, 1) THEN pred_saglik ELSE 0 END AS BIGINT) AS pred_saglik,
      {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in PREDS if c != "pred_saglik")},
      CASE WHEN e % 4 = 0 THEN prob_saglik END AS prob_saglik),
    {CREATED} AS utc_at
  FROM plain),
raw_ruled AS (
  SELECT * REPLACE (CAST(CASE WHEN added THEN 1 ELSE pred_bilgi_paylasimi END AS BIGINT) AS pred_bilgi_paylasimi)
  FROM (SELECT *, pred_bilgi_paylasimi = 0 AND prob_bilgi_paylasimi >= {lit(0.2)}
                  AND {rule("lower(coalesce(tweet_clean, ''))")} AS added FROM cleaned)),
raw AS (
  SELECT *, strftime(utc_at, '%Y-%m-%d %H:%M:%S') AS utc,
    strftime(utc_at + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text,
    coalesce(strftime(utc_at + INTERVAL 3 HOUR, '%Y-%m-%d'), '') AS date,
    coalesce(strftime(utc_at + INTERVAL 3 HOUR, '%H:%M:%S'), '') AS time,
    CAST(added AS INTEGER) AS postprocess_info_v1_added,
    CAST({" + ".join(PREDS)} AS BIGINT) AS pred_label_count,
    CAST({" + ".join(PREDS)} > 0 AS INTEGER) AS pred_any_need
  FROM raw_ruled)"""

RAW_VIEW = """id, {text} AS tweet_clean, utc, date, time, province, district, neighborhood, urgency_score, pred_saglik,
  prob_saglik, pred_bilgi_paylasimi, postprocess_info_v1_added, pred_label_count, pred_any_need"""

GAZ = """
gaz AS (
  SELECT r_name AS province, n_name AS district, 'n' || j AS neighborhood_clean,
    CAST('36.0' AS DOUBLE) + n_nationkey * CAST('0.0625' AS DOUBLE) + j * CAST('0.015625' AS DOUBLE) AS lat,
    CAST('35.0' AS DOUBLE) + n_nationkey * CAST('0.125' AS DOUBLE) + j * CAST('0.03125' AS DOUBLE) AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey, range(5) AS g(j)
  WHERE n_nationkey % 6 <> 5 AND n_regionkey <> 4),
gn AS (SELECT DISTINCT * FROM gaz),
gd AS (SELECT province, district, avg(lat) AS lat, avg(lon) AS lon FROM gaz GROUP BY ALL),
gp AS (SELECT province, avg(lat) AS lat, avg(lon) AS lon FROM gaz GROUP BY ALL)"""

CUSTOMER_GAZ = """
gaz AS (
  SELECT r_name AS province, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE n_name END AS district,
    lower(c_mktsegment || ' ' || (c_custkey % 41)) AS neighborhood_clean,
    36 + (c_custkey % 64) / CAST(64 AS DOUBLE) AS lat, 35 + (c_custkey % 96) / CAST(64 AS DOUBLE) AS lon
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey),
gn AS (SELECT DISTINCT * FROM gaz),
gd AS (SELECT province, district, avg(lat) AS lat, avg(lon) AS lon FROM gaz GROUP BY ALL),
gp AS (SELECT province, avg(lat) AS lat, avg(lon) AS lon FROM gaz GROUP BY ALL)"""

PICKED = """date BETWEEN '2024-01-04' AND '2024-01-20' AND province IN ('ASIA', 'EUROPE', 'MIDDLE EAST')
  AND urgency_score >= 1 AND pred_saglik + pred_altyapi + pred_guvenlik > 0"""

PLACES_ONLY = "date BETWEEN '2024-01-04' AND '2024-01-20' AND province IN ('ASIA', 'EUROPE', 'MIDDLE EAST')"

PLACE = ("province", "district", "neighborhood")
MODE_SIGNAL = {
    "count_rows": ("CAST(count(*) AS DOUBLE)", "TRUE"),
    "count_any_need": ("CAST(count(*) AS DOUBLE)", "pred_any_need = 1"),
    "sum_urgency": ("sum(urgency_score)", "TRUE"),
}


def keys_of(level: str) -> tuple[str, ...]:
    return PLACE[: {"province": 1, "district": 2, "neighborhood": 3}[level]]


def cell_cte(level: str, mode: str, where: str = "TRUE", time: str = "hour") -> str:
    signal, only = MODE_SIGNAL[mode]
    keys = ", ".join((time, *keys_of(level)))
    return f"cell AS (SELECT {keys}, {signal} AS signal FROM signals WHERE ({where}) AND {only} GROUP BY {keys})"


def located_cte(level: str, time: str = "hour") -> str:
    """``located``: cells with coordinates; unplaceable cells stay, without any."""
    keys = keys_of(level)
    joins, lats = [], []
    if level == "neighborhood":
        joins.append(
            "LEFT JOIN gn ON c.province = gn.province AND c.district = gn.district"
            " AND lower(c.neighborhood) = gn.neighborhood_clean AND c.neighborhood <> ''"
        )
        lats.append("gn")
    if level != "province":
        joins.append("LEFT JOIN gd ON c.province = gd.province AND c.district = gd.district")
        lats.append("gd")
    joins.append("LEFT JOIN gp ON c.province = gp.province")
    lats.append("gp")
    lat, lon = (f"coalesce({', '.join(f'{s}.{axis}' for s in lats)})" for axis in ("lat", "lon"))
    ok = "c.neighborhood <> ''" if level == "neighborhood" else "TRUE"
    used = " ".join(
        f"WHEN {s}.lat IS NOT NULL THEN '{ {'gn': 'neighborhood', 'gd': 'district', 'gp': 'province'}[s] }'" for s in lats
    )
    cols = ", ".join(f"c.{k}" for k in (time, *keys))
    return f"""located AS (
  SELECT {cols}, c.signal, {ok} AS placeable,
    CASE WHEN NOT ({ok}) THEN NULL WHEN {lat} IS NULL AND c.province = 'MIDDLE EAST' THEN CAST('36.5' AS DOUBLE)
         ELSE {lat} END AS lat,
    CASE WHEN NOT ({ok}) THEN NULL WHEN {lon} IS NULL AND c.province = 'MIDDLE EAST' THEN CAST('38.25' AS DOUBLE)
         ELSE {lon} END AS lon,
    CASE WHEN NOT ({ok}) THEN 'none' {used} WHEN c.province = 'MIDDLE EAST' THEN 'centroid' ELSE 'none' END AS level_used
  FROM cell c {" ".join(joins)})"""


def ranked_cte(level: str, time: str = "hour") -> str:
    keys = keys_of(level)
    empty = "".join(f", '' AS {k}" for k in PLACE if k not in keys)
    label = f"concat_ws(' / ', {', '.join(f'nullif({k}, {chr(39) * 2})' for k in keys)})"
    return f"""ranked AS (
  SELECT {", ".join((time, *keys))}{empty}, lat, lon, level_used, signal, {label} AS location,
    CAST(row_number() OVER (PARTITION BY {time} ORDER BY signal DESC, {", ".join(keys)}, lat, lon) AS INTEGER) AS rank,
    signal / sum(signal) OVER (PARTITION BY {time}) * CAST(100 AS DOUBLE) AS share_pct,
    CASE WHEN signal >= quantile_cont(signal, 0.95) OVER (PARTITION BY {time}) THEN 'Kritik'
         WHEN signal >= quantile_cont(signal, 0.80) OVER (PARTITION BY {time}) THEN 'Yüksek'
         WHEN signal >= quantile_cont(signal, 0.50) OVER (PARTITION BY {time}) THEN 'Orta'
         ELSE 'İzleme' END AS severity
  FROM located WHERE lat IS NOT NULL AND lon IS NOT NULL AND signal > 0)"""


def busiest_cte(where: str = "TRUE") -> str:
    return f"""busiest AS (
  SELECT hour FROM signals WHERE {where} GROUP BY hour
  ORDER BY count(*) FILTER (pred_any_need = 1) DESC, hour LIMIT 1)"""


POINT_COLUMNS = "hour, rank, location, province, district, neighborhood, lat, lon, level_used, signal, share_pct, severity"


def over_signals(select: str, *ctes: str) -> str:
    return f"WITH {', '.join((SIGNALS, *ctes))} {select}"


def over_plain(select: str) -> str:
    return f"WITH {BASE} {select}"


def over_raw(select: str) -> str:
    return f"WITH {RAW} {select}"


def over_gaz(select: str) -> str:
    return f"WITH {CUSTOMER_GAZ} {select}"


def located_sql(level: str) -> str:
    keys = ", ".join(keys_of(level))
    return over_signals(
        f"SELECT hour, {keys}, signal, lat, lon FROM located WHERE placeable",
        cell_cte(level, "count_any_need"), GAZ, located_cte(level),
    )


def timeline_sql(level: str, mode: str, columns: str, where: str = "TRUE") -> str:
    return over_signals(
        f"SELECT {columns} FROM ranked", cell_cte(level, mode, where), GAZ, located_cte(level), ranked_cte(level)
    )


LONG = "SELECT * FROM (" + each(
    "SELECT {i} AS position, '{x}' AS label, '{n}' AS label_name, CAST(sum(pred_{x}) AS BIGINT) AS count FROM {{src}}",
    " UNION ALL ",
) + ")"


def label_counts_sql(src: str) -> str:
    return LONG.format(src=src)


def prevalence_sql(full_rows: str, declared: dict[str, int]) -> str:
    def full(x: str) -> str:
        return f"CAST({declared[x]} AS BIGINT)" if x in declared else f"CAST(sum(pred_{x}) AS BIGINT)"

    parts = [
        f"""SELECT '{x}' AS label, '{LABEL_NAMES[x]}' AS label_name, {full(x)} AS full_positive,
          {full(x)} / {full_rows} * CAST(100 AS DOUBLE) AS full_rate_pct,
          CAST(sum(pred_{x}) FILTER ({PICKED}) AS BIGINT) AS filtered_positive,
          CAST(sum(pred_{x}) FILTER ({PICKED}) AS BIGINT) / count(*) FILTER ({PICKED})
            * CAST(100 AS DOUBLE) AS filtered_rate_pct
        FROM signals"""
        for x in L
    ]
    return " UNION ALL ".join(parts)


SUMMARY = f"""SELECT count(*) AS total_rows, count(*) FILTER ({PICKED}) AS filtered_rows,
  CAST(sum(pred_any_need) FILTER ({PICKED}) AS BIGINT) AS need_signals,
  CAST(sum(pred_any_need) FILTER ({PICKED}) AS BIGINT) / count(*) FILTER ({PICKED}) * CAST(100 AS DOUBLE)
    AS need_signal_rate_pct,
  count(DISTINCT nullif(province, '')) FILTER ({PICKED}) AS province_count,
  sum(urgency_score) FILTER ({PICKED}) / count(*) FILTER ({PICKED}) AS avg_urgency,
  max(urgency_score) FILTER ({PICKED}) AS max_urgency,
  (SELECT label FROM lc ORDER BY count DESC, position LIMIT 1) AS top_label,
  (SELECT count FROM lc ORDER BY count DESC, position LIMIT 1) AS top_label_count
FROM signals"""

LC = f"picked AS (SELECT * FROM signals WHERE {PICKED}), lc AS ({label_counts_sql('picked')})"

DAILY = f"""SELECT date, count(*) AS rows, CAST(sum(pred_any_need) AS BIGINT) AS needs,
  sum(urgency_score) / count(*) AS urgency FROM signals WHERE {{where}} GROUP BY date"""

TOP = f"""SELECT id, date, time, province, district, neighborhood,
  coalesce(nullif(tweet_clean, ''), tweet) AS text, urgency_score AS urgency,
  concat_ws(',', {each("CASE WHEN pred_{x} = 1 THEN '{x}' END")}) AS labels,
  concat_ws(',', {each("CASE WHEN pred_{x} = 1 THEN '{n}' END")}) AS label_names
FROM signals WHERE {PICKED} ORDER BY urgency_score DESC, pred_label_count DESC, id LIMIT 60"""


def delta_sql(level: str, where: str, parity: bool) -> str:
    before = ("all_signal", "all_places") if parity else ("total_signal", "hotspots")
    ctes = (
        f"known AS (SELECT DISTINCT hour FROM signals WHERE {where})",
        cell_cte(level, "count_any_need", where),
        GAZ,
        located_cte(level),
        """per_hour AS (
  SELECT known.hour,
    sum(signal) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND signal > 0) AS total_signal,
    count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND signal > 0) AS hotspots,
    sum(signal) AS all_signal, count(*) FILTER (signal > 0) AS all_places
  FROM known LEFT JOIN located USING (hour) GROUP BY known.hour)""",
        f"""steps AS (
  SELECT hour, total_signal, hotspots, lag({before[0]}) OVER (ORDER BY hour) AS previous_signal,
    CASE WHEN lag({before[0]}) OVER (ORDER BY hour) IS NOT NULL
         THEN lag({before[1]}) OVER (ORDER BY hour) END AS previous_hotspots
  FROM per_hour)""",
    )
    return over_signals(
        """SELECT hour, total_signal, hotspots, previous_signal, previous_hotspots,
  total_signal - previous_signal AS signal_diff,
  CASE WHEN previous_signal <> 0 THEN (total_signal - previous_signal) / previous_signal * CAST(100 AS DOUBLE) END
    AS signal_diff_pct,
  hotspots - previous_hotspots AS hotspots_diff,
  CASE WHEN previous_hotspots <> 0
       THEN (hotspots - previous_hotspots) / previous_hotspots * CAST(100 AS DOUBLE) END AS hotspots_diff_pct,
  coalesce(previous_signal = 0, FALSE) AS previous_zero
FROM steps WHERE hotspots > 0""",
        *ctes,
    )


# White space of the text operators, in RE2 notation.
SPACES = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
EDGES = rf"^{SPACES}+|{SPACES}+$"

MOJIBAKE = rf"""
misread AS (
  SELECT doc_id, text AS original,
    list_aggregate(list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda h: chr(CAST(('0x' || h) AS INTEGER))), 'string_agg', '') AS bad FROM documents),
damaged AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN bad WHEN 1 THEN bad || ' ' || chr(65533) ELSE original END AS text
  FROM misread),
stripped AS (SELECT doc_id, text, regexp_replace(text, '(?-m){EDGES}', '', 'g') AS t FROM damaged),
fixed AS (
  SELECT doc_id, text, CASE
    WHEN regexp_matches(t, '[\x{{c3}}\x{{c4}}\x{{c5}}\x{{e2}}\x{{fffd}}]') AND NOT regexp_matches(t, '[^\x{{00}}-\x{{ff}}]')
    THEN coalesce(TRY(decode(unhex(list_aggregate(list_transform(regexp_extract_all(t, '(?s).'),
           lambda c: printf('%02x', unicode(c))), 'string_agg', '')))), t)
    ELSE t END AS fixed FROM stripped)
SELECT doc_id, md5(fixed) AS fixed_md5, length(fixed) AS fixed_length, length(fixed) < length(text) AS shorter FROM fixed"""

PRETTY = (
    "CASE label " + each("WHEN '{x}' THEN '{n}'", " ") + " ELSE replace(label, '_', ' ') END"
)

RULE_TEXT = """lower(coalesce(CASE id_n % 3 WHEN 0 THEN upper(tweet_clean)
  WHEN 1 THEN 'su ' || tweet_clean || ' numara' ELSE tweet_clean END, ''))"""

PREDICTED_PLAIN = "concat_ws(',', " + each("CASE WHEN pred_{x} = 1 THEN '{x}' END") + ")"


def _chain(rank: str) -> str:
    """Logits of the stand-in classifier to labels, with the rule's label last."""
    return f"""
counted AS (
  SELECT doc_id, t, length(t) AS size, length(t) - length(replace(t, 'a', '')) AS letters FROM cleaned_docs),
logits AS (SELECT doc_id, t, {each("(size * ({i} + 1) + letters) % 13 - 6 AS z_{x}")} FROM counted),
probs AS (SELECT doc_id, t, {each("1 / (1 + exp(-CAST(z_{x} AS DOUBLE))) AS prob_{x}")} FROM logits)
SELECT doc_id, concat_ws(',', {each("CASE WHEN prob_{x} >= {t} THEN '{x}' END")},
  CASE WHEN {rank} THEN 'bilgi_paylasimi' END) AS predicted FROM probs"""


SCORE_BATCH = rf"""WITH cleaned_docs AS (
  SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{SPACES}+', ' ', 'g')) AS t FROM documents),
{_chain(f"prob_bilgi_paylasimi < {lit(THRESHOLDS['bilgi_paylasimi'])} AND prob_bilgi_paylasimi >= {lit(0.2)} AND {rule('lower(t)')}")}"""

LONG_ITEM = "SELECT {section} AS section, {item} AS item, '{measure}' AS measure, CAST({value} AS DOUBLE) AS value FROM {src}"


def long_part(section: str, item: str, measures: list[str], src: str) -> str:
    return " UNION ALL ".join(
        LONG_ITEM.format(section=f"'{section}'", item=item, measure=m, value=m, src=src) for m in measures
    )


SOURCE_FACTS = [
    "kind", "canonical", "generated_at", "experiment", "threshold_source", "threshold_type", "row_count", "rows_before",
    "rows_after", "duplicate_rows_removed", "content_overlap_note",
]


def overview_sql() -> str:
    ctes = (
        LC,
        f"s AS ({SUMMARY})",
        f"p AS ({prevalence_sql('count(*)', {})})",
        f"d AS ({DAILY.format(where=PICKED)})",
        """pm AS (SELECT province, count(*) AS count, CAST('36.5' AS DOUBLE) AS lat, CAST('38.25' AS DOUBLE) AS lon
           FROM picked WHERE province = 'MIDDLE EAST' GROUP BY province)""",
        f"tm AS ({TOP})",
        "hs AS (SELECT DISTINCT hour, 1 AS listed FROM picked)",
        busiest_cte(PICKED),
    )
    totals = ["total_rows", "filtered_rows", "need_signals", "need_signal_rate_pct", "province_count",
              "avg_urgency", "max_urgency", "top_label_count"]
    rates = ["full_positive", "full_rate_pct", "filtered_positive", "filtered_rate_pct"]
    parts = [
        long_part("summary", "top_label", totals, "s"),
        long_part("label_counts", "label", ["count"], "lc"),
        long_part("prevalence", "label", rates, "p"),
        long_part("temporal", "date", ["rows", "needs", "urgency"], "d"),
        long_part("province_map", "province", ["count", "lat", "lon"], "pm"),
        long_part("top_messages", "id", ["urgency"], "tm"),
        long_part("hours", "hour", ["listed"], "hs"),
        long_part("default_hour", "hour", ["listed"], "(SELECT hour, 1 AS listed FROM busiest)"),
        long_part("source", "fact", ["listed"], f"(SELECT unnest({SOURCE_FACTS}) AS fact, 1 AS listed)"),
    ]
    return over_signals(" UNION ALL ".join(parts), *ctes)


def options_sql() -> str:
    labels = each("('label', '{x}', '{n}')")
    return over_signals(f"""
SELECT 'date_range' AS section, 'min' AS item, min(date) AS value FROM signals
UNION ALL SELECT 'date_range', 'max', max(date) FROM signals
UNION ALL SELECT 'urgency_range', 'min', CAST(min(urgency_score) AS VARCHAR) FROM signals
UNION ALL SELECT 'urgency_range', 'max', CAST(max(urgency_score) AS VARCHAR) FROM signals
UNION ALL SELECT 'rows', 'count', CAST(count(*) AS VARCHAR) FROM signals
UNION ALL SELECT DISTINCT 'province', 'name', province FROM signals WHERE province <> ''
UNION ALL SELECT DISTINCT 'district', 'name', district FROM signals WHERE district <> ''
UNION ALL SELECT * FROM (VALUES {labels},
  ('source', 'kind', 'canonical_final'), ('source', 'canonical', 'True'),
  ('source', 'generated_at', '2024-02-01T00:00:00Z'), ('source', 'experiment', 'exp'),
  ('source', 'threshold_source', 'cv'), ('source', 'threshold_type', 'per_label'),
  ('source', 'row_count', '12000'), ('source', 'rows_before', '12500'), ('source', 'rows_after', '12000'),
  ('source', 'duplicate_rows_removed', '500'), ('source', 'content_overlap_note', NULL))""")


def provenance_sql() -> str:
    declared = {"saglik": 1500, "gida_su": 9000}
    facts = """'canonical_final' AS source_kind, CAST(12500 AS BIGINT) AS rows_before,
      CAST(12000 AS BIGINT) AS rows_after, CAST(500 AS BIGINT) AS duplicate_rows_removed"""

    def line(item: str, counted: str, value: int | None) -> str:
        expected = "CAST(NULL AS BIGINT)" if value is None else f"CAST({value} AS BIGINT)"
        return f"""SELECT '{item}' AS item, {counted} AS counted, {expected} AS declared,
          coalesce({counted} <> {expected}, FALSE) AS differs, {facts} FROM signals"""

    lines = [line("row_count", "count(*)", 12000)]
    lines += [line(x, f"CAST(sum(pred_{x}) AS BIGINT)", declared.get(x)) for x in L]
    return over_signals(" UNION ALL ".join(lines))


def hours_of(where: str) -> str:
    return f"hs AS (SELECT DISTINCT hour FROM signals WHERE {where})"


DETAIL_ROWS = " UNION ALL ".join(
    f"""SELECT id, {i} AS tie, '{x}' AS label, '{LABEL_NAMES[x]}' AS label_name, prob_{x} AS prob,
    {lit(THRESHOLDS[x])} AS threshold,
    CAST(prob_{x} AS FLOAT) >= CAST({lit(THRESHOLDS[x])} AS FLOAT) AS predicted FROM plain"""
    for i, x in enumerate(L)
)

def inserted(number: str, table: str) -> str:
    """A table's rows with words of the rule put into the middle of ``t``, the folded text."""
    words = "['HABER ALAMIYORUZ', 'haber alamıyoruz, bilen var mı', 'DUYURU: dağıtım', 'su lazım', 'telefon 0555']"
    return f"""SELECT *, replace(lower(replace(substring(text, 1, length(text) // 2) || ' ' || {words}[({number}) % 5 + 1] || ' '
      || substring(text, length(text) // 2 + 1), 'İ', 'i')), 'ı', 'i') AS t FROM {table}"""


ORACLE: dict[str, str] = {
    "load_predictions": over_raw(f"SELECT {RAW_VIEW.format(text='nullif(tweet_clean, chr(0))')} FROM raw").replace(
        "nullif(tweet_clean, chr(0))", "nullif(tweet_clean, '')"
    ),
    "load_gazetteer": over_gaz(
        "SELECT province, district, neighborhood_clean, lat, lon FROM gaz WHERE lat > CAST('36.25' AS DOUBLE)"
    ),
    "publish_predictions": over_signals(DAILY.format(where="date BETWEEN '2024-01-04' AND '2024-01-20'")),
    "labels_long": over_signals(
        " UNION ALL ".join(
            f"SELECT id, '{x}' AS label, '{LABEL_NAMES[x]}' AS label_name, CAST(pred_{x} AS BIGINT) AS pred, prob_{x} AS prob FROM signals"
            for x in L
        )
    ),
    "labels_long_discovered": " UNION ALL ".join(
        f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, '{x}' AS label, '{x}' AS label_name,
          CAST(coalesce(l.{x}, 0) AS BIGINT) AS pred, CAST(NULL AS DOUBLE) AS prob
        FROM documents d LEFT JOIN labels l USING (doc_id)"""
        for x in ("quality", "toxic")
    ),
    "fix_mojibake": f"WITH {MOJIBAKE}",
    "normalize_location": over_raw("SELECT id, province, district, neighborhood FROM raw"),
    "parse_date_forms": """SELECT event_id, CASE
    WHEN event_id % 9 IN (0, 1, 5) THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
    WHEN event_id % 9 = 2 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
    WHEN event_id % 9 < 8 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS utc FROM events""",
    "unreadable_times": over_raw("""SELECT count(*) AS cells, count(*) FILTER (e % 7 = 6) AS empty,
  count(*) FILTER (e % 7 = 5) AS unreadable FROM raw"""),
    "parse_created_at": over_raw("SELECT id, utc, local_text AS local FROM raw"),
    "derive_date_time": over_raw("SELECT id, date, time FROM raw"),
    "hour_bucket": over_plain("SELECT id, hour FROM plain"),
    "coerce_numeric": over_raw(
        "SELECT id, urgency_score, pred_saglik, prob_saglik, pred_altyapi, prob_altyapi FROM raw"
    ),
    "info_signal": over_plain(f"SELECT id, {rule(RULE_TEXT)} AS signal FROM (SELECT *, e AS id_n FROM plain)"),
    "info_signal_documents": f"SELECT doc_id, {rule('t')} AS signal FROM ({inserted('doc_id', 'documents')})",
    "info_rule_conversations": f"""SELECT conv_id, turn, CAST(flag AS BIGINT) AS pred_bilgi_paylasimi,
  CASE WHEN flag THEN 'bilgi_paylasimi' ELSE '' END AS predicted FROM (
    SELECT conv_id, turn, (conv_id + turn) % 10 >= 2 AND {rule('t')} AS flag
    FROM ({inserted('conv_id + turn', 'conversations')}))""",
    "label_sums_beyond_int": """SELECT CAST(event_id AS VARCHAR) AS id, event_id * 4000000000 AS pred_saglik,
  event_id * 4000000000 + 4294967294 AS pred_label_count, CAST(1 AS INTEGER) AS pred_any_need FROM events""",
    "info_postprocess": over_signals("SELECT id, pred_bilgi_paylasimi, postprocess_info_v1_added FROM signals"),
    "label_count_any_need": over_signals("SELECT id, pred_label_count, pred_any_need FROM signals"),
    "row_labels": over_signals(
        f"""SELECT id, array_to_string(found, ',') AS labels, array_to_string(found[1:2], ',') AS first_two FROM (
  SELECT id, list_filter([{each("CASE WHEN pred_{x} = 1 THEN '{x}' END")}], lambda v: v IS NOT NULL) AS found
  FROM signals)"""
    ),
    "pretty_label": f"""SELECT event_id, {PRETTY} AS name FROM (SELECT event_id, CASE WHEN event_id % 2 = 0
  THEN [{each("'{x}'")}][event_id % 9 + 1] ELSE event_type || '_type_' || (event_id % 5) END AS label FROM events)""",
    "clean_text": rf"""SELECT doc_id, md5(t) AS md5, length(t) AS length FROM (
  SELECT doc_id, trim(regexp_replace(nfc_normalize(CASE WHEN doc_id % 2 = 0
    THEN replace(replace(text, chr(233), 'e' || chr(769)), ' ', chr(160) || ' ' || chr(12288)) ELSE text END),
    '{SPACES}+', ' ', 'g')) AS t FROM documents)""",
    "location_label": over_plain(
        """SELECT id, concat_ws(' / ', nullif(province, ''), nullif(district, ''), nullif(neighborhood, '')) AS location,
  province || ' / ' || district || ' / ' || neighborhood AS location_full FROM plain"""
    ),
    "filter_date_range": over_signals(
        "SELECT id, date FROM signals WHERE CAST(date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"
    ),
    "filter_province": over_signals("SELECT id, province FROM signals WHERE province IN ('ASIA', 'EUROPE')"),
    "filter_district": over_signals("SELECT id, district FROM signals WHERE district IN ('NATION_3', 'NATION_21')"),
    "filter_neighborhood": over_signals("SELECT id, neighborhood FROM signals WHERE neighborhood IN ('N2', 'N6')"),
    "filter_urgency_min": over_signals("SELECT id, urgency_score FROM signals WHERE urgency_score >= 3"),
    "filter_labels_any": over_signals("SELECT id FROM signals WHERE pred_saglik + pred_barinma > 0"),
    "filter_labels_all": over_signals("SELECT id FROM signals WHERE pred_gida_su = 1 AND pred_altyapi = 1"),
    "filter_search": """SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
  WHERE contains(replace(lower(text), chr(223), 'ss'), 'esse')""",
    "filter_search_ligatures": """SELECT s AS search, CAST(doc_id AS VARCHAR) AS id FROM documents, (VALUES ('fi'), ('ss')) AS v(s)
  WHERE contains(replace(lower(text), chr(223), 'ss'), s)""",
    "filter_search_published": """SELECT s AS search, CAST(doc_id AS VARCHAR) AS id
  FROM documents, (VALUES ('EßE', 'esse'), ('apache license', 'apache license'),
    ('licensed under the apache', 'licensed under the apache'), ('555-', '555-')) AS v(s, needle)
  WHERE contains(replace(lower(text), chr(223), 'ss'), needle)""",
    "hotspots_published": over_signals(
        f"SELECT {POINT_COLUMNS} FROM ranked",
        cell_cte("neighborhood", "count_any_need", PLACES_ONLY), GAZ, located_cte("neighborhood"), ranked_cte("neighborhood"),
    ),
    "summary_published": over_signals(SUMMARY.replace(PICKED, PLACES_ONLY), LC.replace(PICKED, PLACES_ONLY)),
    "replaced_days": over_signals(
        DAILY.format(where="TRUE").replace("FROM signals", "FROM replaced"),
        """replaced AS (
  SELECT * REPLACE (urgency_score + CASE WHEN date BETWEEN '2024-01-10' AND '2024-01-12' THEN 8 ELSE 0 END AS urgency_score)
  FROM signals WHERE date NOT BETWEEN '2024-01-10' AND '2024-01-12' OR CAST(id AS BIGINT) % 3 > 0)""",
    ),
    "filter_search_regex": """SELECT conv_id || '-' || turn AS id FROM conversations
  WHERE regexp_matches(lower(text), '(é|e)[a-z]*on[ .]')""",
    "filter_any_need": over_signals("SELECT id FROM signals WHERE pred_any_need = 1"),
    "filter_hour": over_signals(
        """SELECT '2024-01-10T05:00:00' AS requested, hour, province, count(*) AS n_rows FROM signals
  WHERE hour = '2024-01-10T05:00:00' GROUP BY hour, province
UNION ALL SELECT '1999-01-01T00:00:00', hour, province, count(*) FROM signals
  WHERE hour = (SELECT hour FROM busiest) GROUP BY hour, province""",
        busiest_cte(),
    ),
    "filter_during": over_signals(
        """SELECT id, province FROM signals
  WHERE local >= TIMESTAMP '2024-01-10 05:00:00' AND local < TIMESTAMP '2024-01-10 06:00:00'"""
    ),
    "filter_combined": over_signals(
        f"""SELECT id, date, province, district, urgency_score FROM signals WHERE {PICKED}
  AND district IN ('NATION_3', 'NATION_8', 'NATION_12', 'NATION_19')
  AND (contains(lower(tweet_clean), 'haber') OR contains(lower(tweet), 'haber'))"""
    ),
    "geocode_province": located_sql("province"),
    "geocode_district": located_sql("district"),
    "geocode_neighborhood": located_sql("neighborhood"),
    "geocode_stored": located_sql("neighborhood"),
    "geocode_level_used": over_signals(
        """SELECT level_used, count(*) AS places, sum(signal) AS signal FROM located WHERE placeable
  GROUP BY level_used""",
        cell_cte("neighborhood", "count_any_need"), GAZ, located_cte("neighborhood"),
    ),
    "gazetteer_neighborhoods": over_gaz("SELECT * FROM gn"),
    "gazetteer_districts": over_gaz("SELECT * FROM gd"),
    "gazetteer_provinces": over_gaz("SELECT * FROM gp"),
    "province_counts": over_signals(
        f"SELECT province, count(*) AS count FROM signals WHERE {PICKED} AND province <> '' GROUP BY province"
    ),
    "province_map": over_signals(
        f"""SELECT province, count(*) AS count, CAST('36.5' AS DOUBLE) AS lat, CAST('38.25' AS DOUBLE) AS lon
  FROM signals WHERE {PICKED} AND province = 'MIDDLE EAST' GROUP BY province"""
    ),
    "province_ranking": over_signals(
        """SELECT province, count(*) AS count, any_value(c.lat) AS lat, any_value(c.lon) AS lon
  FROM signals JOIN (VALUES ('ASIA', CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)), ('EUROPE', CAST(3 AS DOUBLE),
    CAST(4 AS DOUBLE)), ('AFRICA', CAST(5 AS DOUBLE), CAST(6 AS DOUBLE))) AS c(province, lat, lon) USING (province)
  GROUP BY province ORDER BY count DESC, province LIMIT 2"""
    ),
    "label_counts": over_signals("SELECT label, label_name, count FROM lc", LC),
    "prevalence": over_signals(prevalence_sql("count(*)", {})),
    "prevalence_declared": over_signals(prevalence_sql("12000", {"saglik": 1500, "gida_su": 9000})),
    "temporal_daily": over_signals(DAILY.format(where=PICKED)),
    "temporal_counts": over_signals(f"SELECT date, count(*) AS count FROM signals WHERE {PICKED} GROUP BY date"),
    "summary": over_signals(SUMMARY, LC),
    "options": options_sql(),
    "distinct_locations": over_signals("SELECT DISTINCT district AS value FROM signals WHERE district <> ''"),
    "hours": over_signals(f"SELECT DISTINCT hour FROM signals WHERE {PICKED}"),
    "default_hour": over_signals("SELECT hour FROM busiest", busiest_cte()),
    "hour_label_counts": over_signals(
        "SELECT label, label_name, count FROM lc WHERE count > 0 ORDER BY count DESC, position LIMIT 6",
        busiest_cte(),
        "one AS (SELECT * FROM signals WHERE hour = (SELECT hour FROM busiest))",
        f"lc AS ({label_counts_sql('one')})",
    ),
    "hour_cursor": over_signals(
        """SELECT hour, coalesce(lag(hour) OVER (ORDER BY hour), hour) AS previous_hour,
  coalesce(lead(hour) OVER (ORDER BY hour), min(hour) OVER ()) AS next_hour FROM hs""",
        hours_of(PICKED),
    ),
    "provenance_check": provenance_sql(),
    "provenance_published": provenance_sql(),
    "provenance_duplicates": """WITH kept AS (SELECT text, source FROM documents GROUP BY text, source),
f AS (SELECT (SELECT count(*) FROM documents) AS before, (SELECT count(*) FROM kept) AS after,
  (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS contents)
SELECT 'rows_before' AS item, before AS counted, CAST(10000 AS BIGINT) AS declared, before <> 10000 AS differs FROM f
UNION ALL SELECT 'rows_after', after, CAST(9900 AS BIGINT), after <> 9900 FROM f
UNION ALL SELECT 'duplicate_rows_removed', before - contents, CAST(100 AS BIGINT), before - contents <> 100 FROM f
UNION ALL SELECT 'duplicate_rows_left', after - contents, CAST(0 AS BIGINT), after <> contents FROM f""",
    "without_duplicates": "SELECT min(conv_id * 1000 + turn) AS id, role FROM conversations GROUP BY role, text",
    "hotspot_signal_count_rows": over_signals(
        "SELECT hour, province, district, signal FROM cell", cell_cte("district", "count_rows")
    ),
    "hotspot_signal_any_need": over_signals(
        "SELECT hour, province, district, neighborhood, signal FROM cell",
        cell_cte("neighborhood", "count_any_need", PICKED),
    ),
    "hotspot_signal_urgency": over_signals(
        "SELECT hour, province, signal FROM cell", cell_cte("province", "sum_urgency")
    ),
    "hotspots_all_levels": over_signals(
        """SELECT hour, 'province' AS level, province, '' AS district, '' AS neighborhood,
    CAST(count(*) AS DOUBLE) AS signal FROM signals WHERE pred_any_need = 1 GROUP BY hour, province
UNION ALL SELECT hour, 'district', province, district, '', CAST(count(*) AS DOUBLE)
  FROM signals WHERE pred_any_need = 1 GROUP BY hour, province, district
UNION ALL SELECT hour, 'neighborhood', province, district, neighborhood, CAST(count(*) AS DOUBLE)
  FROM signals WHERE pred_any_need = 1 GROUP BY hour, province, district, neighborhood"""
    ),
    "hotspot_rank": timeline_sql(
        "province", "count_rows", "hour, province, district, neighborhood, signal, rank"
    ),
    "hotspot_share": timeline_sql(
        "province", "sum_urgency", "hour, province, district, neighborhood, signal, share_pct"
    ),
    "hotspot_severity": over_signals(
        "SELECT date AS day, province, district, signal, severity FROM ranked",
        cell_cte("district", "sum_urgency", time="date"), GAZ,
        located_cte("district", "date"), ranked_cte("district", "date"),
    ),
    "hotspots": over_signals(
        f"SELECT {POINT_COLUMNS} FROM ranked WHERE hour = (SELECT hour FROM busiest)",
        cell_cte("neighborhood", "count_any_need", PICKED), GAZ, located_cte("neighborhood"),
        ranked_cte("neighborhood"), busiest_cte(PICKED),
    ),
    "hotspots_known_hour": over_signals(
        f"SELECT {POINT_COLUMNS} FROM ranked WHERE hour = '2024-01-10T05:00:00'",
        cell_cte("neighborhood", "count_any_need"), GAZ, located_cte("neighborhood"), ranked_cte("neighborhood"),
    ),
    "hotspots_timeline": timeline_sql("district", "count_any_need", POINT_COLUMNS),
    "hotspot_stats": over_signals(
        """SELECT (SELECT hour FROM busiest) AS hour, sum(signal) FILTER (shown) AS total_signal,
  count(*) FILTER (shown) AS hotspots, max(signal) FILTER (shown) AS top_signal,
  count(*) FILTER (shown) / (SELECT count(*) FROM cell WHERE hour = (SELECT hour FROM busiest))
    * CAST(100 AS DOUBLE) AS geo_coverage_pct,
  avg(lat) FILTER (shown) AS center_lat, avg(lon) FILTER (shown) AS center_lon
FROM (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AND signal > 0 AS shown FROM located
      WHERE hour = (SELECT hour FROM busiest))""",
        cell_cte("neighborhood", "count_any_need"), GAZ, located_cte("neighborhood"), busiest_cte(),
    ),
    "hour_delta": delta_sql("province", "TRUE", False),
    "hour_delta_parity": delta_sql("district", PICKED, True),
    "top_hotspots": over_signals(
        "SELECT hour, rank, location, signal FROM ranked WHERE hour = (SELECT hour FROM busiest) AND rank <= 12",
        cell_cte("neighborhood", "count_any_need"), GAZ, located_cte("neighborhood"),
        ranked_cte("neighborhood"), busiest_cte(),
    ),
    "top_messages": over_signals(TOP),
    "top_messages_many": over_signals(
        "SELECT id, urgency_score AS urgency FROM signals ORDER BY urgency_score DESC, pred_label_count DESC, id LIMIT 700"
    ),
    "ticker": rf"""WITH talk AS (
  SELECT printf('%08d-%04d', conv_id, turn) AS id, conv_id % 10 AS urgency, role AS province, conv_id,
    CASE WHEN conv_id % 4 = 0 OR conv_id % 10 > 7 THEN '' ELSE replace(regexp_replace(text, '{EDGES}', '', 'g'), chr(10), ' ') END AS line
  FROM conversations)
SELECT id, CASE WHEN length(line) > 140 THEN substring(line, 1, 137) || '...' ELSE line END AS text, province,
  CASE conv_id % 2 WHEN 0 THEN 'saglik,gida_su' ELSE 'arama_kurtarma,barinma' END AS labels
FROM talk WHERE line <> '' ORDER BY urgency DESC, id LIMIT 18""",
    "message_list": over_signals(
        f"""SELECT date, time, province, district, neighborhood, urgency_score, tweet_clean, {", ".join(PREDS)}
  FROM signals WHERE {PICKED} ORDER BY id LIMIT 500"""
    ),
    "overview": overview_sql(),
    "stream_hourly_signals": over_signals(
        """SELECT hour, province, count(*) AS n_rows, count(*) FILTER (pred_any_need = 1) AS n_need_rows,
  sum(urgency_score) AS urgency FROM signals GROUP BY hour, province"""
    ),
    "stream_closed_hours": over_signals(
        """SELECT hour, province, count(*) AS n_rows, count(*) FILTER (pred_any_need = 1) AS n_need_rows,
  sum(urgency_score) AS urgency FROM signals GROUP BY hour, province"""
    ),
    "stream_hotspots": timeline_sql("district", "count_any_need", POINT_COLUMNS),
    "stream_clean": over_raw(f"SELECT {RAW_VIEW.format(text='tweet_clean')} FROM raw"),
    "score_batch": SCORE_BATCH,
    "apply_thresholds": over_plain(f"SELECT id, {PREDICTED_PLAIN} AS predicted FROM plain"),
    "score_postprocess": over_signals(f"SELECT id, {PREDICTED_PLAIN} AS predicted FROM signals"),
    "score_detail": over_plain(
        f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY prob DESC, tie) AS INTEGER) AS position,
  label, label_name, prob, threshold, predicted FROM ({DETAIL_ROWS})"""
    ),
    "linear_scorer": "SELECT vec_id, "
    + ", ".join(
        f"""list_dot_product(CAST(embedding AS DOUBLE[]), CAST([{", ".join(map(str, w))}] AS DOUBLE[])) > 0 AS positive_{x}"""
        for x, w in weights().items()
    )
    + " FROM embeddings",
}
