"""Queries for text operators, each over all documents and their whole texts."""

from pyspark.sql import functions as F

from gleaner.catalog import query, table
from gleaner.functions import labels
from gleaner.functions.fixed import KEYWORD_STOP_WORDS, TOKEN_STOP_WORDS
from gleaner.functions.storage import materialise, spread
from gleaner.functions.text import LINE_BREAK, SPACE, normalise_whitespace
from gleaner.operators import charts, documents, joined, keywords, similarity, summaries


def docs(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id")


def quoted(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def strip_sql(x):
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def compact_sql(x):
    return strip_sql(rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def prose_sql(x):
    return (rf"({x} <> '' and len(string_split_regex({x}, '{SPACE}+')) >= 5 "
            rf"and length(regexp_replace({x}, '\P{{L}}+', '', 'g')) / greatest(length({x}), 1) >= 0.60)")


def key_sql(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


# Numbered raw sentences of every document; ``prose`` marks the clean ones.
SENTENCES_SQL = rf"""
compacted as (select doc_id, text, {compact_sql('text')} as body from documents),
pieces as (select doc_id, unnest(string_split(regexp_replace(body, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1))) as piece,
  generate_subscripts(string_split(regexp_replace(body, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), 1) as ord from compacted),
stripped as (select doc_id, ord, {strip_sql('piece')} as sentence from pieces),
sentences as (select doc_id, ord, sentence, regexp_matches(sentence, '[\p{{L}}\p{{N}}_]') as any_word,
  {prose_sql('sentence')} as prose from stripped),
clean as materialized (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as pos, sentence from sentences where prose)
"""


def packing_sql(name, source, size):
    """Recursive CTE that packs numbered rows (doc_id, pos, sentence) into chunks of about ``size`` characters."""
    return f"""{name} as (
 select doc_id, pos, sentence, 0 as chunk, length(sentence) as filled from {source} where pos = 0
 union all
 select s.doc_id, s.pos, s.sentence, case when p.filled + length(s.sentence) > {size} then p.chunk + 1 else p.chunk end,
  case when p.filled + length(s.sentence) > {size} then length(s.sentence) else p.filled + length(s.sentence) end
 from {name} p join {source} s on s.doc_id = p.doc_id and s.pos = p.pos + 1)"""


ALL_SENTENCES_SQL = """worded as materialized (
 select doc_id, row_number() over (partition by doc_id order by ord) - 1 as pos, sentence from sentences where any_word)"""


@query("clean_sentences", f"with {SENTENCES_SQL} select doc_id, pos::int as pos, sentence from clean")
def clean_sentences(spark, folder):
    return documents.sentence_table(docs(spark, folder), "doc_id", "text")


@query("text_chunks", f"""with recursive {SENTENCES_SQL}, {ALL_SENTENCES_SQL}, {packing_sql('packed', 'worded', 4000)}
select doc_id, chunk::int as chunk, string_agg(sentence, ' ' order by pos) as body from packed group by all
union all select doc_id, 0, body from compacted where body <> '' and doc_id not in (select doc_id from worded)""")
def text_chunks(spark, folder):
    return documents.text_chunks(docs(spark, folder), "doc_id", "text")


@query("clean_lines", rf"""with lines as (select doc_id, unnest(string_split_regex(text, '{LINE_BREAK}')) as line,
  generate_subscripts(string_split_regex(text, '{LINE_BREAK}'), 1) as ord from documents),
stripped as (select doc_id, ord, {strip_sql('line')} as line from lines),
joined as (select doc_id, string_agg(line, ' ' order by ord) as body from stripped where {prose_sql('line')} group by doc_id)
select doc_id, {compact_sql('body')} as text from joined""")
def clean_lines(spark, folder):
    return documents.clean_lines(docs(spark, folder), "doc_id", "text")


@query("clean_pages", rf"""with lines as (select conv_id, turn, unnest(string_split_regex(text, '{LINE_BREAK}')) as line,
  generate_subscripts(string_split_regex(text, '{LINE_BREAK}'), 1) as ord from conversations),
stripped as (select conv_id, turn, ord, {strip_sql('line')} as line from lines),
pages as (select conv_id, turn, string_agg(line, ' ' order by ord) as body from stripped where {prose_sql('line')} group by all),
joined as (select conv_id, string_agg(body, chr(10) || chr(10) order by turn) as body from pages group by all)
select conv_id, {compact_sql('body')} as text from joined""")
def clean_pages(spark, folder):
    return documents.clean_lines(table(spark, folder, "conversations"), "conv_id", "text", page="turn")


STATS_SQL = rf"""{packing_sql('s_packing', 'worded', 4500)},
chunked as (select doc_id, max(chunk) + 1 as n from s_packing group by doc_id),
counted as (select doc_id, count(*) as n from clean group by doc_id),
doc_stats as materialized (
select c.doc_id, length(body)::int as char_count, len(list_filter(string_split_regex(body, '{SPACE}+'), lambda w: w <> ''))::int as word_count,
 coalesce(s.n, 0)::int as sentence_count, len(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_\-'']*'))::int as token_count,
 len(list_filter(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_\-'']*'),
   lambda t: length(t) > 2 and lower(t) not in {quoted(TOKEN_STOP_WORDS)}))::int as filtered_token_count,
 coalesce(k.n, (body <> '')::int)::int as chunk_count, coalesce(s.n, 0) > 0 as readable
from compacted c left join counted s using (doc_id) left join chunked k using (doc_id))"""


@query("text_stats", f"with recursive {SENTENCES_SQL}, {ALL_SENTENCES_SQL}, {STATS_SQL} select * from doc_stats")
def text_stats(spark, folder):
    return documents.text_stats(docs(spark, folder), "doc_id", "text")


# Non-ASCII letters and digits become '0', so that an ASCII word boundary sees them as word characters.
def tokens_sql(x):
    plain = rf"regexp_replace(regexp_replace(lower({x}), '[^\x00-\x7F\P{{L}}]', '0', 'g'), '[^\x00-\x7F\P{{N}}]', '0', 'g')"
    return (rf"list_filter(regexp_extract_all({plain}, '\b[a-z][a-z\-'']{{2,}}\b'), "
            rf"lambda t: t not in {quoted(KEYWORD_STOP_WORDS)})")


def bigrams_sql(x):
    return f"list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"


PASSAGES_SQL = f"""
packed as materialized (select * from packing),
chunks as (select doc_id, chunk as pos, string_agg(sentence, ' ' order by pos) as passage from packed group by doc_id, chunk
  union all select doc_id, 0, body from compacted where body <> '' and doc_id not in (select doc_id from worded)),
sentence_counts as (select doc_id, count(*) as n from clean group by doc_id),
passages as (select doc_id, pos, sentence as passage from clean where doc_id in (select doc_id from sentence_counts where n >= 2)
  union all select doc_id, pos, passage from chunks where doc_id not in (select doc_id from sentence_counts where n >= 2))
"""

KEYWORD_STEPS_SQL = f"""{packing_sql('packing', 'worded', 4000)}, {PASSAGES_SQL},
passage_counts as (select doc_id, count(*) as n from passages group by doc_id),
tokens as (select doc_id, pos, {tokens_sql('passage')} as t from passages),
terms as (select doc_id, pos, unnest({bigrams_sql('t')}) as term from tokens),
counts as (select doc_id, pos, term, count(*) as tf from terms group by all),
vocabulary as (select doc_id, term, holding from (select doc_id, term, count(*) as holding, sum(tf) as total from counts group by all)
  qualify row_number() over (partition by doc_id order by total desc, term) <= 500),
weights as (select doc_id, pos, term, tf * (ln((1 + n) / (1 + holding)) + 1) as w
  from counts join vocabulary using (doc_id, term) join passage_counts using (doc_id)),
scores as (select doc_id, term, max(w / norm) as score
  from weights join (select doc_id, pos, sqrt(sum(w * w)) as norm from weights group by all) using (doc_id, pos) group by all),
keywords as materialized (select doc_id, row_number() over (partition by doc_id order by round(score, 9) desc, term) as rank, term, score,
  round(score / max(score) over (partition by doc_id), 4) as importance from scores
  qualify row_number() over (partition by doc_id order by round(score, 9) desc, term) <= 20)
"""


KEYWORDS_SQL = f"{SENTENCES_SQL}, {ALL_SENTENCES_SQL}, {KEYWORD_STEPS_SQL}"


@query("tfidf_keywords", f"with recursive {KEYWORDS_SQL} select doc_id, rank::int as rank, term, round(score, 6) as score, importance from keywords")
def tfidf_keywords(spark, folder):
    return keywords.tfidf_keywords(table(spark, folder, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))


@query("keyword_cloud", f"""with recursive {KEYWORDS_SQL}
select doc_id, rank::int as rank, term, round(0.5 + 0.5 * importance, 6) as weight from keywords where rank <= 12""")
def keyword_cloud(spark, folder):
    found = charts.keyword_cloud(keywords.tfidf_keywords(table(spark, folder, "documents"), "doc_id", "text"), ["doc_id"])
    return found.withColumn("weight", F.round("weight", 6))


CORPUS_KEYWORDS_SQL = f"""{SENTENCES_SQL},
tokens as (select doc_id, pos, {tokens_sql('sentence')} as t from clean),
terms as (select doc_id, pos, unnest({bigrams_sql('t')}) as term from tokens),
counts as (select doc_id, pos, term, count(*) as tf from terms group by all),
vocabulary as (select term, count(*) as holding from counts group by term order by sum(tf) desc, term limit 500),
weights as (select doc_id, pos, term, tf * (ln((1 + (select count(*) from clean)) / (1 + holding)) + 1) as w from counts join vocabulary using (term)),
scores as (select term, max(w / norm) as score
  from weights join (select doc_id, pos, sqrt(sum(w * w)) as norm from weights group by all) using (doc_id, pos) group by all),
corpus_terms as materialized (select row_number() over (order by round(score, 9) desc, term)::int as rank, term, round(score, 6) as score,
 round(score / max(score) over (), 4) as importance from scores qualify row_number() over (order by round(score, 9) desc, term) <= 20)"""


@query("corpus_keywords", f"with {CORPUS_KEYWORDS_SQL} select * from corpus_terms")
def corpus_keywords(spark, folder):
    return keywords.corpus_keywords(docs(spark, folder), "doc_id", "text").withColumn("score", F.round("score", 6))


@query("corpus_contexts", f"""with {CORPUS_KEYWORDS_SQL}, plain as (select doc_id, pos, sentence, {key_sql('sentence')} as plain from clean)
select rank, term, (row_number() over (partition by term order by doc_id, pos))::int as mention, doc_id, pos::int as pos, sentence
from corpus_terms join plain on contains(plain, {key_sql('term')}) and {key_sql('term')} <> ''
qualify row_number() over (partition by term order by doc_id, pos) <= 2""")
def corpus_contexts(spark, folder):
    source = documents.prepare_documents(docs(spark, folder), "doc_id", "text")
    return keywords.corpus_contexts(source, keywords.corpus_keywords(source, "doc_id", "text"), "doc_id", "text")


CONTEXTS_SQL = f"""plain as materialized (select doc_id, pos, sentence, {key_sql('sentence')} as plain from clean),
contexts as (select doc_id, rank, term, row_number() over (partition by doc_id, term order by pos) as mention, pos, sentence
from keywords join plain using (doc_id) where contains(plain, {key_sql('term')}) and {key_sql('term')} <> ''
qualify row_number() over (partition by doc_id, term order by pos) <= 2)"""


@query("keyword_contexts", f"""with recursive {KEYWORDS_SQL}, {CONTEXTS_SQL}
select doc_id, rank::int as rank, term, mention::int as mention, pos::int as pos, sentence from contexts""")
def keyword_contexts(spark, folder):
    source = documents.prepare_documents(docs(spark, folder), "doc_id", "text")
    return keywords.keyword_contexts(source, keywords.tfidf_keywords(source, "doc_id", "text"), "doc_id", "text")


def textrank_sql(prefix, source, count):
    """Ranks of the rows (unit, pos, sentence) of ``source`` and the best ``count`` positions per unit, as {prefix}_best."""
    return rf"""
{prefix}_sized as materialized (select unit, count(*) as n from {source} group by unit),
{prefix}_words as (select unit, pos, word, count(*)::double as c from
  (select unit, pos, unnest(regexp_extract_all(lower(sentence), '\p{{L}}[\p{{L}}''-]*')) as word from {source}) group by all),
{prefix}_lengths as (select unit, pos, ln(greatest(sum(c), 1)) as lg from {prefix}_words group by all),
{prefix}_edges as (select a.unit, a.pos as i, b.pos as j, sum(a.c * b.c) as shared
  from {prefix}_words a join {prefix}_words b using (unit, word) group by all),
{prefix}_scaled as (select e.unit, i, j, case when abs(x.lg + y.lg) <= 1e-8 then shared else shared / (x.lg + y.lg) end as w
  from {prefix}_edges e join {prefix}_lengths x on x.unit = e.unit and x.pos = i join {prefix}_lengths y on y.unit = e.unit and y.pos = j),
{prefix}_links as materialized (select unit, i, j, w / (sum(w) over (partition by unit, i) + 1e-7) as m from {prefix}_scaled),
{prefix}_grid as (select s.unit, a.pos as i, b.pos as j, s.n from {prefix}_sized s join {source} a using (unit) join {source} b using (unit)),
{prefix}_matrix as materialized (select unit, any_value(n) as n, list(incoming order by j) as columns from
  (select g.unit, g.j, any_value(g.n) as n, list(coalesce(m, 0.0) order by g.i) as incoming
   from {prefix}_grid g left join {prefix}_links l on l.unit = g.unit and l.i = g.i and l.j = g.j group by g.unit, g.j) group by unit),
{prefix}_power as (
 select unit, 0 as step, list_transform(columns, lambda c: 1.0::double / n) as p, 1.0::double as moved from {prefix}_matrix
 union all
 select unit, step, q, list_distance(p, q) from (
  select m.unit, r.step + 1 as step, r.p, list_transform(m.columns, lambda c: 0.15 / m.n * list_sum(r.p) + 0.85 * list_dot_product(c, r.p)) as q
  from {prefix}_power r join {prefix}_matrix m using (unit) where r.moved > 1e-4)),
{prefix}_final as (select unit, arg_max(p, step) as p from {prefix}_power group by unit),
{prefix}_ordered as (select unit, pos, sentence, row_number() over (partition by unit order by pos) as place from {source}),
{prefix}_best as materialized (select unit, pos, sentence, place from {prefix}_ordered join {prefix}_final using (unit) join {prefix}_sized using (unit)
 qualify row_number() over (partition by unit order by round(p[place], 9) desc, place) <= {count})
"""


TEXTRANK_SQL = f"""{packing_sql('t_packing', 'clean', 4500)},
units as materialized (select doc_id * 10000 + chunk as unit, pos, sentence, doc_id, chunk from t_packing), {textrank_sql('t', 'units', 2)}"""
SECOND_SQL = textrank_sql('d', 'merged', 'case when chunks = 1 then 1000000 else 4 end').replace(
    'join d_sized using (unit)', 'join d_sized using (unit) join chunk_totals on doc_id = unit')
SUMMARY_SQL = f"""{TEXTRANK_SQL},
chunk_totals as (select doc_id, max(chunk) + 1 as chunks from units group by doc_id),
merged as materialized (select unit // 10000 as unit, pos, sentence from t_best), {SECOND_SQL},
summaries as materialized (select unit as doc_id, any_value(chunks)::int as chunks, string_agg(sentence, ' ' order by place) as summary
from d_best join chunk_totals on doc_id = unit group by unit)"""


@query("textrank_summary", f"""with recursive {SENTENCES_SQL}, {TEXTRANK_SQL}
select unit // 10000 as doc_id, (unit % 10000)::int as chunk, any_value(n)::int as sentence_count,
 string_agg((place - 1)::varchar, ',' order by place) as picked, string_agg(sentence, ' ' order by place) as summary
from t_best join t_sized using (unit) group by unit""")
def textrank_summary(spark, folder):
    found = summaries.textrank_summary(docs(spark, folder), "doc_id", "text")
    return found.withColumn("picked", F.array_join(F.col("picked").cast("array<string>"), ","))


@query("document_summary", f"with recursive {SENTENCES_SQL}, {SUMMARY_SQL} select * from summaries")
def document_summary(spark, folder):
    return summaries.document_summary(docs(spark, folder), "doc_id", "text")


def entities_sql(keys):
    found = " union all ".join(
        f"""select {keys} unnest(regexp_extract_all(text, '{p.replace("'", "''")}')) as text, '{label}' as label from documents"""
        for label, p in documents.ENTITY_PATTERNS.items())
    part = f"partition by {keys.rstrip(', ')}" if keys else ""
    return f"""entity_mentions as (select {keys} {compact_sql('text')} as text, label from ({found})),
entity_counted as (select {keys} text, label, count(*) as count from entity_mentions where length(text) >= 2 group by all),
entities as materialized (select *, row_number() over ({part} order by count desc, text, label)::int as rank from entity_counted
qualify row_number() over ({part} order by count desc, text, label) <= 20)"""


@query("entity_counts", f"with {entities_sql('doc_id, ')} select * from entities")
def entity_counts(spark, folder):
    return documents.entity_counts(docs(spark, folder), ["doc_id"], "text")


@query("corpus_entities", f"with {entities_sql('')} select * from entities")
def corpus_entities(spark, folder):
    return documents.entity_counts(docs(spark, folder), [], "text")


@query("label_forms", f"""with named as (select p_partkey, p_name || '_' || p_brand || '/' || p_size || p_type as label from part),
keyed as (select p_partkey, label, {key_sql('label')} as "key" from named)
select p_partkey, "key", array_to_string(list_filter(string_split("key", ' '), lambda t: t <> ''), ',') as tokens,
 array_to_string(list_transform(regexp_extract_all("key", '[0-9]+|[a-z]+| '), lambda t: upper(t[1]) || t[2:]), '') as readable from keyed""")
def label_forms(spark, folder):
    label = F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.col("p_type"))
    return table(spark, folder, "part").select(
        "p_partkey", labels.normalise_key(label).alias("key"), F.array_join(labels.label_tokens(label), ",").alias("tokens"),
        labels.humanize_label(label).alias("readable"))


@query("metric_texts", """with v as (select o_orderkey, o_totalprice as x, round(o_totalprice * o_custkey) as y, o_custkey::double as z from orders),
forms as (select o_orderkey, unnest([x, y, z, null]) as x, unnest(['price', 'product', 'key', 'none']) as name from v)
select o_orderkey, name, case when x is null then 'N/A' when abs(x) >= 1e6 then format('{:.1f}M', x / 1e6)
 when abs(x) >= 1e3 then format('{:.1f}K', x / 1e3) when x = floor(x) then format('{:,}', x::bigint) else format('{:,.1f}', x) end as shown from forms""")
def metric_texts(spark, folder):
    forms = table(spark, folder, "orders").select("o_orderkey", F.inline(F.array(
        F.struct(F.lit("price").alias("name"), F.col("o_totalprice").alias("x")),
        F.struct(F.lit("product").alias("name"), F.round(F.col("o_totalprice") * F.col("o_custkey")).alias("x")),
        F.struct(F.lit("key").alias("name"), F.col("o_custkey").cast("double").alias("x")),
        F.struct(F.lit("none").alias("name"), F.lit(None).cast("double").alias("x")))))
    return forms.select("o_orderkey", "name", labels.format_metric(F.col("x")).alias("shown"))


@query("flat_texts", f"""select doc_id, {strip_sql("regexp_replace(text, '[ \t]+', ' ', 'g')")} as text from documents""")
def flat_texts(spark, folder):
    return docs(spark, folder).select("doc_id", normalise_whitespace(F.col("text")).alias("text"))


@query("corpus_near_duplicates", r"""with recursive worded as materialized (select doc_id, n_chars,
  list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as w from documents),
ranked as (select *, row_number() over (order by n_chars desc nulls last, doc_id) as place from worded),
each as materialized (select doc_id, place, len(w) as n, unnest(w) as word from ranked),
links as materialized (select a.doc_id as better, b.doc_id as worse from each a join each b on a.word = b.word and a.place < b.place
  group by all having 100 * count(*) > 55 * greatest(any_value(a.n), any_value(b.n))),
repeats as materialized (select doc_id, better, row_number() over (order by place) as step from ranked
  join (select worse as doc_id, list(better) as better from links group by worse) using (doc_id)),
walk as (select 0::bigint as step, []::bigint[] as gone
  union all select r.step, case when len(list_filter(r.better, lambda b: not list_contains(gone, b))) > 0 then list_append(gone, r.doc_id) else gone end
  from walk join repeats r on r.step = walk.step + 1)
select doc_id, len(w)::bigint as n_words, not list_contains((select arg_max(gone, step) from walk), doc_id) as kept from worded""")
def corpus_near_duplicates(spark, folder):
    return similarity.near_duplicates(docs(spark, folder), score="n_chars")


# All documents as one body of text, in the place of ``documents``.
BODY_SQL = f"""bodies as (select doc_id, {compact_sql('text')} as body from documents),
whole as (select 0 as doc_id, string_agg(body, chr(10) || chr(10) order by doc_id) as text, count(*) as texts from bodies where body <> ''),
{SENTENCES_SQL.replace('from documents', 'from whole')}"""


@query("corpus_stats", rf"""with recursive {BODY_SQL},
w as (select row_number() over (order by ord) as i, length(sentence) as n from sentences where any_word),
c as materialized (select i, n, (sum(n) over (order by i))::bigint as upto from w),
following as materialized (select a.i, case when b.i is not null then greatest(a.i + 1, b.i) end as nxt from c a asof left join c b on a.upto - a.n + 4500 < b.upto),
walk as (select 1::bigint as i, 1::bigint as chunk where exists (select 1 from c)
  union all select nxt, chunk + 1 from walk join following using (i) where nxt <= (select max(i) from c)),
s as (select body, (select count(*) from clean) as sentences from compacted)
select (select texts from whole) as texts, length(body)::bigint as char_count,
 len(list_filter(string_split_regex(body, '{SPACE}+'), lambda w: w <> ''))::bigint as word_count, len(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_\-'']*'))::bigint as token_count,
 len(list_filter(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_\-'']*'), lambda t: length(t) > 2 and lower(t) not in {quoted(TOKEN_STOP_WORDS)}))::bigint as filtered_token_count,
 sentences::bigint as sentence_count, coalesce((select max(chunk) from walk), 1)::bigint as chunk_count, sentences > 0 as readable from s""")
def corpus_stats(spark, folder):
    return joined.corpus_stats(docs(spark, folder), "doc_id", "text")


def _level_sql(before, after):
    """One level of condensing numbered picks: up to 24 neighbours are ranked together, unless 12 or fewer are left."""
    count = f"(select case when n > 12 then 2 else 1000000 end from {after}_n)"
    return f"""{after}_n as materialized (select count(distinct number) as n from {before}),
{after}_in as materialized (select number // (select case when n > 12 then greatest(2, least(24, ceil(n / 12)::bigint)) else 1 end from {after}_n) as unit,
  number * 1000 + place as pos, sentence from {before}), {textrank_sql(after, f'{after}_in', count)},
{after}_picks as materialized (select unit as number, row_number() over (partition by unit order by pos) as place, sentence from {after}_best)"""


@query("corpus_summary", rf"""with recursive {SENTENCES_SQL}, {TEXTRANK_SQL},
numbered as (select unit, row_number() over (order by doc_id, chunk) - 1 as number from (select distinct unit, doc_id, chunk from units)),
picks as materialized (select number, row_number() over (partition by number order by pos) as place, sentence from t_best join numbered using (unit)),
{_level_sql('picks', 'e')}, {_level_sql('e_picks', 'f')}, {_level_sql('f_picks', 'g')},
h_in as materialized (select 0 as unit, number * 1000 + place as pos, sentence from g_picks),
{textrank_sql('h', 'h_in', '(select case when count(distinct number) <= 1 then 1000000 else 4 end from g_picks)')}
select string_agg(sentence, ' ' order by pos) as summary from h_best""")
def corpus_summary(spark, folder):
    return summaries.corpus_summary(docs(spark, folder), "doc_id", "text")
