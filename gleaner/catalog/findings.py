"""Queries for findings: insights, matches, links and the final ranking."""

from pyspark.sql import functions as F

from gleaner.catalog import query, table
from gleaner.catalog.tables import EVENT_MEASURES, EVENTS_SQL, LINEITEM_TYPES, events
from gleaner.catalog.texts import (
    ALL_SENTENCES_SQL, CONTEXTS_SQL, KEYWORD_STEPS_SQL, KEYWORDS_SQL, SENTENCES_SQL, SUMMARY_SQL, entities_sql, key_sql,
)
from gleaner.catalog.texts import STATS_SQL as TEXT_STATS_SQL
from gleaner.functions import labels
from gleaner.functions.fixed import DOWN_WORDS, UP_WORDS
from gleaner.operators import anomalies, charts, correlation, fusion, groups, insights, keywords, matching, profile, ranking, trends
from gleaner.plans.links import global_ranking, link_findings
from gleaner.plans.tables import analyse_table
from gleaner.plans.texts import analyse_corpus, analyse_documents

DEPTH = 5
UP_SQL = "[" + ", ".join(f"'{w}'" for w in UP_WORDS) + "]"
DOWN_SQL = "[" + ", ".join(f"'{w}'" for w in DOWN_WORDS) + "]"


def _number(x, decimals, grouped=False, signed=False):
    return f"format('{{:{'+' if signed else ''}{',' if grouped else ''}.{decimals}f}}', {x})"


LABEL_SQL = "array_to_string(list_transform(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: upper(t[1]) || t[2:]), ' ')"


def label_sql(x):
    return LABEL_SQL.format(x=x)


def joined_evidence(found):
    """Evidence lists as one text, so that both sides of a comparison show the same."""
    return found.withColumn("evidence", F.array_join("evidence", " | "))


STATS_SQL = "stats_long as (" + " union all ".join(f"""
 select {i} as ordinal, '{c}' as c, avg({c}) as mean, stddev_pop({c}) as std, coalesce(skewness({c}), 0) as skew,
  min({c})::double as lo, max({c})::double as hi, 100.0 * (count(*) - count({c})) / count(*) as missing from marked"""
    for i, c in enumerate(EVENT_MEASURES)) + ")"

DATA_SQL = f"""{EVENTS_SQL}, {STATS_SQL},
labelled as (select *, {label_sql('c')} as label, abs(std / nullif(mean, 0)) as cv from stats_long),
series as ({" union all ".join(f"select {i} as o, '{c}' as c, date_trunc('day', ts)::timestamp as x, sum({c})::double as y from marked group by all" for i, c in enumerate(EVENT_MEASURES))}),
indexed as (select *, row_number() over (partition by c order by x) - 1 as idx from series),
fitted as (select o, c, {label_sql('c')} as label, regr_slope(y, idx) as slope,
  100 * (arg_max(y, x) - arg_min(y, x)) / nullif(abs(arg_min(y, x)), 0) as pct from indexed group by o, c),
moved as (select *, case when pct > 3 then 'rising' when pct < -3 then 'falling' when slope > 0 then 'rising' when slope < 0 then 'falling' else 'stable' end as direction from fitted),
flags as (select count(*) filter (z_value > 3 or z_accepted > 3 or z_user_id > 3) as n, count(*) filter (z_value > 3) as n0,
  count(*) filter (z_accepted > 3) as n1, count(*) filter (z_user_id > 3) as n2 from scored),
flag_list as (select n, list_filter([('Value', n0), ('Accepted', n1), ('User Id', n2)], lambda f: f[2] > 0) as f from flags),
leaders as ({" union all ".join(f"select {i} as o, '{c}' as c, event_type as g, sum({c})::double as total, count({c}) as n from marked group by event_type" for i, c in enumerate(EVENT_MEASURES))}),
first_leaders as (select *, {label_sql('c')} as label from leaders qualify row_number() over (partition by o order by total desc, g) = 1),
found as (
 select 0 + ordinal * 3 as ordinal, label || ' Distribution' as title,
  label || ' is heavily ' || case when skew > 0 then 'right' else 'left' end || '-skewed (skew=' || {_number('skew', 2)} || '), meaning most records cluster around '
  || case when skew > 0 then 'lower' else 'higher' end || ' values while a ' || case when skew > 0 then 'higher-value' else 'lower-value' end || ' tail pulls the average '
  || case when skew > 0 then 'upward' else 'downward' end || ' — typical of uneven distribution patterns such as seasonal spikes or outlier transactions.' as description,
  least(0.95, 0.60 + abs(skew) * 0.10) as score,
  ['Skewness: ' || {_number('skew', 2)}, 'Mean: ' || {_number('mean', 2, True)}, 'Std: ' || {_number('std', 2, True)}] as evidence, 'data' as source
  from labelled where abs(skew) >= 1
 union all select ordinal * 3 + 1, label || ' Variability', label || ' shows high relative variability (coefficient of variation = ' || {_number('cv', 2)}
  || '), indicating inconsistent performance across records. This level of spread can signal structural differences between groups or data quality issues.',
  least(0.88, 0.55 + cv * 0.10), ['CV: ' || {_number('cv', 2)}, 'Std: ' || {_number('std', 2, True)}, 'Mean: ' || {_number('mean', 2, True)}], 'data' from labelled where cv >= 0.75
 union all select ordinal * 3 + 2, label || ' Completeness', label || ' has ' || {_number('missing', 1)}
  || '% missing values. This volume of missingness may bias averages and weaken downstream groupby comparisons — consider imputation or excluding this column from trend analysis.',
  0.50 + missing / 200, ['Missing: ' || {_number('missing', 1)} || '%'], 'data' from labelled where missing >= 20
 union all select 1000000 + o, label || ' Trend', label || ' has ' || case when direction = 'rising' then 'increased' else 'decreased' end || ' by ' || {_number('abs(pct)', 1)}
  || '% across the observed day periods (linear slope = ' || {_number('slope', 3, signed=True)} || ' per day). This sustained '
  || case when direction = 'rising' then 'upward' else 'downward' end || ' movement suggests a structural shift rather than random fluctuation.',
  least(0.98, 0.70 + abs(pct) / 200),
  ['Change: ' || {_number('pct', 1, signed=True)} || '%', 'Direction: ' || direction, 'Slope: ' || {_number('slope', 4, signed=True)} || '/day'], 'data' from moved where abs(pct) >= 8
 union all select 2000000, 'Anomalous Records Detected', 'Anomaly detection flagged ' || n || ' suspicious rows (' || n || ' by z-score threshold >3σ, 0 by Isolation Forest). '
  || 'Strongest deviations are concentrated in: ' || case when len(f) > 0 then array_to_string(list_transform(f[1:3], lambda c: c[1]), ', ') else 'the numeric metrics' end
  || '. These records may represent data entry errors, genuine outliers, or exceptional business events that deserve manual review.',
  least(0.94, 0.65 + n / 200), case when len(f) > 0 then list_transform(f, lambda c: c[1] || ': ' || c[2] || ' outlier(s)') else ['Total flagged: ' || n] end, 'anomaly' from flag_list where n > 0
 union all select 3000000 + o, 'Event Type Leader: ' || g, 'Among all Event Type groups, ''' || g || ''' leads ' || label || ' with a total of ' || {_number('total', 2, True)}
  || ' across ' || format('{{:,}}', n) || ' records (average of ' || {_number('total / n', 2, True)} || ' per record). This concentration suggests this segment should be prioritised in resource allocation decisions.',
  0.68, ['Total ' || label || ': ' || {_number('total', 2, True)}, 'Records: ' || format('{{:,}}', n), 'Avg per record: ' || {_number('total / n', 2, True)}], 'data' from first_leaders
 union all select 4000000, 'Correlation: Value ↔ Accepted', 'Value and Accepted are strongly positively correlated (r = ' || {_number('r', 3)}
  || '). This relationship suggests that changes in one metric reliably accompany changes in the other.', least(0.90, 0.55 + r * 0.40), ['Pearson r = ' || {_number('r', 3)}], 'data'
  from (select round(corr(value, accepted), 3) as r from marked))"""


@query("data_insights", f"""with {DATA_SQL}
select ordinal::bigint as ordinal, title, description, round(score, 4) as score, array_to_string(evidence, ' | ') as evidence, source from found order by score desc, ordinal limit {3 * DEPTH}""")
def data_insights(spark, folder):
    df = events(spark, folder)
    found = insights.data_insights(
        profile.numeric_stats(df, EVENT_MEASURES), trends.datetime_trend(df, ["ts"], EVENT_MEASURES),
        anomalies.anomaly_summary(df, EVENT_MEASURES), groups.groupby_tables(df, ["event_type"], EVENT_MEASURES),
        correlation.top_correlation(df, EVENT_MEASURES), DEPTH)
    return joined_evidence(found.withColumn("score", F.round("score", 4)))


TEXT_SQL = f"""{SENTENCES_SQL}, {ALL_SENTENCES_SQL}, {TEXT_STATS_SQL}, {KEYWORD_STEPS_SQL}, {SUMMARY_SQL}, {entities_sql('doc_id, ')},
topic_terms as (select *, {label_sql('term')} as label from keywords where rank <= 6),
topics as (select doc_id, string_agg(label, ', ' order by rank) as named,
  list(label || ': ' || format('{{:.3f}}', score) order by rank) filter (rank <= 5) as evidence from topic_terms group by doc_id),
early as (select *, min(rank) over (partition by doc_id, label) as label_rank from entities where rank <= 15),
placed as (select *, dense_rank() over (partition by doc_id order by label_rank) as label_place,
  row_number() over (partition by doc_id, label order by rank) as item_place, count(*) over (partition by doc_id, label) as label_items from early),
label_texts as (select doc_id, label_place, any_value(label) as label, any_value(label_items) as n,
  string_agg(text || ' (×' || count || ')', ', ' order by item_place) filter (item_place <= 3) as items from placed group by doc_id, label_place),
named as (select doc_id, string_agg(label || ': ' || items, ' | ' order by label_place) filter (label_place <= 4) as coverage,
  list(label || ': ' || n || ' entity/entities' order by label_place) filter (label_place <= 6) as evidence from label_texts group by doc_id),
totals as (select doc_id, count(*) as n from entities group by doc_id),
text_found as (
 select doc_id, 0 as ordinal, 'Document Summary' as title, summary as description, 0.95::double as score,
  ['Word count: ' || format('{{:,}}', word_count), 'Sentences analysed: ' || format('{{:,}}', sentence_count)] as evidence from summaries join doc_stats using (doc_id)
 union all select doc_id, 1, 'Dominant Topics', 'The document''s dominant topics, ranked by TF-IDF importance, are: ' || named
  || '. These terms appear with significantly higher frequency relative to their general usage, indicating the document''s core subject matter.', 0.88, evidence from topics
 union all select doc_id, 2, 'Named Entities', 'Named entity recognition identified ' || n || ' distinct entities. Coverage: ' || coverage
  || '. High entity density in a specific category may indicate the document is domain-specific reporting (e.g. financial, geographic, organisational).', 0.80, evidence
  from named join totals using (doc_id)
 union all select doc_id, 3, 'Large Document Processing', 'The document was large enough to require chunked processing (' || chunk_count
  || ' chunks of ~4,500 characters). Summarisation was applied per-chunk and then consolidated via a second-pass TextRank for coherent output.', 0.45,
  ['Chunks: ' || chunk_count, 'Words: ' || format('{{:,}}', word_count)] from doc_stats where chunk_count > 1),
text_findings as (select f.* from text_found f join doc_stats using (doc_id) where readable)"""


@query("text_insights", f"""with recursive {TEXT_SQL} select doc_id, ordinal::bigint as ordinal, title, description, score, array_to_string(evidence, ' | ') as evidence, 'text' as source from text_findings""")
def text_insights(spark, folder):
    return joined_evidence(analyse_documents(table(spark, folder, "documents"), "doc_id", "text").insights)


# The four titles are too different to count as near-duplicates, so ranking a document's findings only sorts them.
@query("ranked_text_insights", f"""with recursive {TEXT_SQL},
scaled as (select *, round(score / max(score) over (partition by doc_id), 4) as scaled from text_findings)
select doc_id, row_number() over (partition by doc_id order by scaled desc, ordinal)::int as rank, scaled as score, title, description, score as raw_score, array_to_string(evidence, ' | ') as evidence,
 'text' as source, description as text, trunc(scaled * 100)::int as priority, trunc(scaled * 100)::int as score_pct,
 case when scaled >= 0.85 then 'high' when scaled >= 0.65 then 'medium' else 'low' end as band, 'TEXT' as source_label from scaled""")
def ranked_text_insights(spark, folder):
    return joined_evidence(ranking.insight_records(analyse_documents(table(spark, folder, "documents"), "doc_id", "text").ranked))


COLUMN_NAMES = ["small_ring_price", "red_widget_count", "bolt size", "p_name", "p_brand", "l_extendedprice"]


def _overlap_sql(c):
    tokens = "[" + ", ".join(f"'{t}'" for t in labels.column_key(c).split()) + "]"
    return f"len(list_intersect(list_distinct(t), {tokens})) / greatest(len(list_distinct(t)), len(list_distinct({tokens})))"


@query("term_column_overlap", f"""with terms as (select term, list_filter(string_split(trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') as t
  from (select distinct p_name as term from part union select distinct p_type from part)),
scored as (select term, unnest([{", ".join(f"'{c}'" for c in COLUMN_NAMES)}]) as "column", unnest([{", ".join(_overlap_sql(c) for c in COLUMN_NAMES)}]) as score,
  unnest(range({len(COLUMN_NAMES)})) as place from terms)
select term, "column", round(score, 6) as score, 'overlap' as match_method from scored where score >= 0.45
qualify row_number() over (partition by term order by score desc, place) = 1""")
def term_column_overlap(spark, folder):
    part = table(spark, folder, "part")
    terms = part.select(F.col("p_name").alias("term")).union(part.select("p_type"))
    return matching.overlap_matches(terms, COLUMN_NAMES).withColumn("score", F.round("score", 6))


def lexical_sql(terms, columns):
    """CTEs that give ``matches``: best column per distinct term of ``terms`` by token overlap or Ratcliff-Obershelp ratio.

    ``runs`` holds the length of the common run that starts at each pair of equal characters; ``blocks`` splits every
    pair of texts at its longest common run, again and again.
    """
    names = ", ".join(f"'{c}'" for c in columns)
    return f"""
term_keys as (select term, {key_sql('term')} as a from (select distinct term from {terms})),
column_keys as (select "column", place, {key_sql('"column"')} as b from (select unnest([{names}]) as "column", unnest(range({len(columns)})) as place)),
pairs as materialized (select row_number() over () as pair, a, b from (select distinct a, b from term_keys, column_keys where a <> '' and b <> '')),
a_chars as (select distinct a, unnest(range(length(a))) as i from term_keys), b_chars as (select distinct b, unnest(range(length(b))) as j from column_keys),
same as (select pair, i, j from pairs join a_chars using (a) join b_chars using (b) where pairs.a[i + 1] = pairs.b[j + 1]),
islands as (select *, i - row_number() over (partition by pair, i - j order by i) as island from same),
runs as materialized (select pair, i, j, max(i) over (partition by pair, i - j, island) - i + 1 as run from islands),
blocks as (
 select pair, 0::bigint as alo, length(a)::bigint as ahi, 0::bigint as blo, length(b)::bigint as bhi, 0::bigint as k from pairs
 union all
 select pair, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) from (
  select pair, alo, ahi, blo, bhi, -best[1] as k, best[2] as i, best[3] as j from (
   select s.pair, alo, ahi, blo, bhi, min([-least(run, ahi - i, bhi - j), i, j]) as best
   from blocks s join runs r on r.pair = s.pair and i >= alo and i < ahi and j >= blo and j < bhi group by s.pair, alo, ahi, blo, bhi))),
ratios as (select pair, 2 * sum(k) / (length(any_value(a)) + length(any_value(b))) as ratio from blocks join pairs using (pair) group by pair),
pair_scores as (select a, b, greatest(ratio,
  len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))
  / greatest(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' '))))) as score from ratios join pairs using (pair)),
matches as materialized (select term, "column", score from term_keys join pair_scores using (a) join column_keys using (b) where score >= 0.45
 qualify row_number() over (partition by term order by score desc, place) = 1)"""


MATCH_COLUMNS = list(LINEITEM_TYPES) + ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("term_column_match", f"""with recursive {KEYWORDS_SQL}, {lexical_sql('keywords', MATCH_COLUMNS)}
select term, "column", round(score, 6) as score, 'difflib' as match_method from matches""")
def term_column_match(spark, folder):
    docs = table(spark, folder, "documents")
    columns = table(spark, folder, "lineitem").columns + table(spark, folder, "events").columns
    return matching.lexical_matches(keywords.tfidf_keywords(docs, "doc_id", "text"), columns).withColumn("score", F.round("score", 6))


@query("cosine_match", """with parts as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, avg(x) as x from parts group by all),
dots as (select v.vec_id, m.label, sum(v.x * m.x) as d from parts v join means m using (i) group by all),
norms as (select vec_id, sqrt(sum(x * x)) as n from parts group by all), label_norms as (select label, sqrt(sum(x * x)) as n from means group by all),
scored as (select vec_id, d.label, coalesce(d / nullif(norms.n * label_norms.n, 0), 0) as score from dots d join norms using (vec_id) join label_norms on label_norms.label = d.label)
select vec_id as term, 'label_' || label as "column", round(score, 5) as score, 'semantic' as match_method from scored where score >= 0.1
qualify row_number() over (partition by vec_id order by score desc, label) = 1""")
def cosine_match(spark, folder):
    vectors = table(spark, folder, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")) \
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    names = means.select(F.col("label").alias("position"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("column"), "vector")
    found = matching.cosine_matches(vectors.select(F.col("vec_id").alias("term"), F.col("embedding").alias("vector")), names, threshold=0.1)
    return found.withColumn("score", F.round("score", 5))


@query("cosine_similarity", """with a as (select vec_id, embedding::double[] as e from embeddings)
select x.vec_id, round(coalesce(list_cosine_similarity(x.e, y.e), 0), 6) as cosine from a x join a y on y.vec_id = x.vec_id + 1""")
def cosine_similarity(spark, folder):
    vectors = table(spark, folder, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(matching.cosine_similarity(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("text_direction", f"""with said as (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as plain from documents),
marked as (select doc_id, list_has_any(string_split(plain, ' '), {UP_SQL}) as up, list_has_any(string_split(plain, ' '), {DOWN_SQL}) as down from said)
select doc_id, case when up and not down then 'rising' when down and not up then 'falling' end as direction from marked""")
def text_direction(spark, folder):
    return table(spark, folder, "documents").select("doc_id", labels.text_direction(F.array("text")).alias("direction"))


def _event_table(spark, folder, forest=False):
    return analyse_table(events(spark, folder), ["event_id"], ["event_type", "ts", "value", "accepted", "user_id"], forest=forest)


FUSION_COLUMNS = ["value", "accepted", "user_id", "event_type", "ts"]
LINK_SQL = f"""{KEYWORDS_SQL}, {entities_sql('doc_id, ')},
link_terms as (select doc_id, rank::bigint as ordinal, term, importance from keywords where rank <= 12
 union all select doc_id, rank + 1000000, text, 0.40 from entities where rank <= 10),
{lexical_sql('link_terms', FUSION_COLUMNS)},
linked as (select t.*, "column", score as match_score from link_terms t join matches using (term)
 qualify row_number() over (partition by doc_id, term, "column" order by ordinal) = 1)"""


@query("match_list", f"""with recursive {LINK_SQL}
select doc_id, row_number() over (partition by doc_id order by ordinal)::int as rank, term, "column", round(match_score, 3) as score, 'difflib' as match_method
from linked qualify row_number() over (partition by doc_id order by ordinal) <= 20""")
def match_list(spark, folder):
    text = analyse_documents(table(spark, folder, "documents"), "doc_id", "text")
    return link_findings(_event_table(spark, folder), text).matches


@query("match_links", f"""with recursive {LINK_SQL}, listed as (
 select doc_id, row_number() over (partition by doc_id order by ordinal)::int as rank, term, "column", round(match_score, 3) as score from linked)
select doc_id, rank, term, case "column" when 'user_id' then 'User Id' when 'event_type' then 'Event Type' else upper("column"[1]) || "column"[2:] end as label,
 floor(score * 100)::int as percent, 'difflib' as match_method from listed where rank <= 12""")
def match_links(spark, folder):
    return charts.match_links(match_list(spark, folder), ["doc_id"])


@query("fusion_signals", f"""with recursive {LINK_SQL}, {CONTEXTS_SQL}, {DATA_SQL},
said as (select doc_id, term, trim(regexp_replace(lower(string_agg(sentence, ' ' order by mention)), '[^a-z0-9]+', ' ', 'g')) as plain
 from contexts where rank <= 12 group by doc_id, term),
directions as (select doc_id, term, list_has_any(string_split(plain, ' '), {UP_SQL}) as up, list_has_any(string_split(plain, ' '), {DOWN_SQL}) as down from said),
facts as (select m.c as "column", m.label, m.direction, m.pct, mean, lo, hi from moved m join stats_long s on s.c = m.c where pct is not null),
signals as (select l.doc_id, l.ordinal, l.term, l."column", label, direction, pct, mean, lo, hi, importance, match_score,
  case when up and not down then 'rising' when down and not up then 'falling' end as said
 from linked l join facts f on f."column" = l."column" left join directions d on d.doc_id = l.doc_id and d.term = l.term),
scored_signals as (select *, least(0.99, 0.65 + importance * 0.15 + match_score * 0.10 + abs(pct) / 500) as raw from signals)
select doc_id, ordinal, term, "column", 'trend' as "case", 'Text ↔ Data: ' || label as title,
 'The text references ''' || term || ''' (' || case when said is null then 'corresponds to' when said = direction then 'aligns with' else 'contradicts' end
 || ' the data signal). Structured data shows ' || label || ' is ' || direction || ' by ' || format('{{:.1f}}', abs(pct)) || '% across day periods. '
 || case when said is null then '' when said = direction then 'Both the text narrative and the data trend point in the same direction, reinforcing this signal.'
  else 'The text narrative and data trend point in opposite directions — this discrepancy warrants investigation.' end
 || ' Current mean: ' || format('{{:,.2f}}', mean) || ' (range: ' || format('{{:,.2f}}', lo) || ' – ' || format('{{:,.2f}}', hi) || ').' as description,
 round(raw, 4) as score, array_to_string(['Keyword importance: ' || format('{{:.3f}}', importance), 'Match score: ' || format('{{:.3f}}', match_score),
  'Data trend: ' || direction || ' ' || format('{{:.1f}}', abs(pct)) || '%'], ' | ') as evidence, 'fusion' as source
from scored_signals qualify row_number() over (partition by doc_id order by raw desc, ordinal) <= 6""")
def fusion_signals(spark, folder):
    text = analyse_documents(table(spark, folder, "documents"), "doc_id", "text")
    return joined_evidence(link_findings(_event_table(spark, folder), text).signals.withColumn("score", F.round("score", 4)))


@query("ranked_insights")
def ranked_insights(spark, folder):
    """The whole analysis: a table, a corpus, their links, one ranked list."""
    data = _event_table(spark, folder, forest=True)
    text = analyse_corpus(table(spark, folder, "documents"), "doc_id", "text")
    links = link_findings(data, text)
    return joined_evidence(global_ranking([data.ranked, text.ranked, links.ranked]))
