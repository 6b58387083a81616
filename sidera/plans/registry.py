"""The queries over the catalogue, purchase and prediction tables, with SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidera.functions import arrays as A
from sidera.functions import text as X
from sidera.operators import items as I
from sidera.operators import quality, ranking, semantic_ids, sequences, statistics, vectors
from sidera.plans import samples as S
from sidera.plans.fixtures import code_sequences, items, packed_code, packed_token, predictions, purchases, sid_sequences, sids, table, user_sequences, with_views
from sidera.sources.io import latest_by_key
from sidera.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__.lstrip("_")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql) if views else sql
        return f

    return add


def spread_sql(key: str, seed: int) -> str:
    """A seeded arithmetic hash of a whole number, 0 to 2^31 - 2, that both engines read alike; no step leaves 64 bits.

    The seed is in both factors of a product, so another seed gives another order, not the same one turned.
    """
    a = f"((((({key}) % 2147483647) + 2147483647) % 2147483647 * 48271 + {seed * 69621 % 2147483647}) % 2147483647)"
    return f"(({a} % 65521 + {seed % 65521 + 1}) * (({a} * 16807 + {seed}) % 2147483647) % 2147483647)"


def spread(key: str, seed: int) -> F.Column:
    return F.expr(spread_sql(key, seed))


# ---- sequences

QUERIES["user_sequences"] = user_sequences
ORACLES["user_sequences"] = with_views("select * from user_sequences")


@query("select user_id, sequence[-20:] as sequence, len(sequence[-20:])::bigint as seq_len from raw_sequences where len(sequence) >= 30")
def sequences_capped(spark, sf):
    long = sequences.build(purchases(spark, sf), "user_id", "item_id", ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey"], 30, None)
    return long.select("user_id", A.tail(F.col("sequence"), 20).alias("sequence")).withColumn("seq_len", F.size("sequence").cast("long"))


@query("select count(*) as n, min(seq_len) as lo, max(seq_len) as hi, round(avg(seq_len), 6) as mean, median(seq_len) as med, round(stddev_samp(seq_len), 6) as sd from user_sequences")
def sequence_len_stats(spark, sf):
    return user_sequences(spark, sf).agg(F.count("*").alias("n"), F.min("seq_len").alias("lo"), F.max("seq_len").alias("hi"), F.round(F.avg("seq_len"), 6).alias("mean"), F.percentile("seq_len", F.lit(0.5)).alias("med"), F.round(F.stddev_samp("seq_len"), 6).alias("sd"))


QUERIES["sid_sequences"] = sid_sequences
ORACLES["sid_sequences"] = with_views("select * from sid_sequences")


@query("select user_id, item_id, o_orderdate, l_orderkey, l_linenumber, l_partkey from purchases where item_id in (select item_id from items where rating_number >= 20)")
def valid_events(spark, sf):
    return sequences.of_known(purchases(spark, sf), items(spark, sf).where("rating_number >= 20"), "item_id").select("user_id", "item_id", "o_orderdate", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"select c_custkey, case when row_number() over (order by {spread_sql('c_custkey', 42)}, c_custkey) > (select count(*) - floor(count(*) * 0.1) from customer) then 'val' else 'train' end as split from customer", views=False)
def split_exact_tail(spark, sf):
    return sequences.split_exact(table(spark, sf, "customer").select("c_custkey"), spread("c_custkey", 42), ["c_custkey"], 0.1, False)


@query(f"select c_custkey, case when row_number() over (order by {spread_sql('c_custkey', 7)}, c_custkey) <= (select floor(count(*) * 0.05) from customer) then 'val' else 'train' end as split from customer", views=False)
def split_exact_head(spark, sf):
    return sequences.split_exact(table(spark, sf, "customer").select("c_custkey"), spread("c_custkey", 7), ["c_custkey"], 0.05, True)


# ---- items

_ITEM = "item_id, title, rating_number"


@query(f"select {_ITEM} from items where length(title) > 50 and length(description_text) > 500 and rating_number >= 20")
def item_filter_valid(spark, sf):
    return I.valid(items(spark, sf), "item_id").select("item_id", "title", "rating_number")


@query(
    """select item_id, 'Product: ' || coalesce(title, '') || E'\\n\\nDescription: ' || coalesce(description_text, '') || E'\\n\\nFeatures: ' || coalesce(features_text, '') || E'\\n\\nCategory: ' || coalesce(main_category, '')
    || E'\\n\\nStore: ' || coalesce(store, '') || E'\\n\\nAverage rating: ' || coalesce(average_rating::varchar, '') || ', Rating count: ' || coalesce(rating_number, 0) || E'\\n\\nPrice: ' || coalesce(price::varchar, '') || E'\\n\\nCategories: ' || coalesce(categories_text, '') as item_context from items"""
)
def item_context(spark, sf):
    return I.fill_nulls(items(spark, sf)).select("item_id", I.item_context().alias("item_context"))


@query("select p_partkey, case when v is null or regexp_replace(v, '^\\s+|\\s+$', '', 'g') = '' or v = 'NA' then null else v end as v from (select p_partkey, case p_partkey % 4 when 0 then 'NA' when 1 then '  ' when 2 then null else p_name end as v from part)", views=False)
def null_normalise(spark, sf):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, "NA").when(k == 1, "  ").when(k == 3, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", v.alias("v")).select("p_partkey", X.na_to_null(F.col("v")).alias("v"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_type else p_brand end as category from part", views=False)
def category_fallback(spark, sf):
    c = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", I.category_or(c, F.col("p_type")).alias("category"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'N/A' else p_brand || ', ' || p_type end as csv, case when p_partkey % 5 = 0 then null else [p_brand] end as filled from part", views=False)
def list_columns(spark, sf):
    k = F.col("p_partkey")
    both = F.when(k % 2 == 1, F.array("p_brand", "p_type"))
    one = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return table(spark, sf, "part").select("p_partkey", X.list_to_csv(both).alias("csv"), I.empty_to_null(one).alias("filled"))


_LOG = "(select user_id, value, event_id, case when value > 50 then 'late' end as error from events)"


@query(f"select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1", views=False)
def latest_by_key_query(spark, sf):
    return latest_by_key(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "value")


QUERIES["latest_by_key"] = QUERIES.pop("latest_by_key_query")
ORACLES["latest_by_key"] = ORACLES.pop("latest_by_key_query")


def _log(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "value", F.when(F.col("value") > 50, "late").alias("error"))


@query("select c_custkey from customer where c_custkey not in (select user_id from (select user_id, value, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and not coalesce(value > 50, false))", views=False)
def resume_todo(spark, sf):
    return incremental.todo(table(spark, sf, "customer").select("c_custkey"), _log(spark, sf), "c_custkey", "event_id")


@query("select c_custkey, value from customer left join (select user_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and not coalesce(value > 50, false)) on c_custkey = user_id", views=False)
def resume_results(spark, sf):
    return incremental.results(table(spark, sf, "customer").select("c_custkey"), _log(spark, sf), "c_custkey", "event_id", ["value"])


@query("""select i.item_id, title, clean_title, species from items i join (select item_id, case when p_partkey % 7 = 0 then null else lower(title) end as clean_title from items where p_partkey % 10 <> 0) c using (item_id)
    left join (select item_id, case when p_partkey % 2 = 0 then 'dog' else 'cat' end as species from items where p_partkey % 3 = 0) m using (item_id)""")
def merge_left_inner(spark, sf):
    base = items(spark, sf)
    k = F.col("p_partkey")
    cleaned = base.where(k % 10 != 0).select("item_id", F.when(k % 7 == 0, "NA").otherwise(F.lower("title")).alias("clean_title"), F.lit("x").alias("clean_description"), F.array(F.lit("y")).alias("clean_features"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    cleaned = cleaned.withColumn("clean_title", F.when(F.col("ordinal") == 2, F.col("clean_title")).otherwise("old"))
    meta = base.where(k % 3 == 0).select("item_id", F.when(k % 2 == 0, "dog").otherwise("cat").alias("pet_species"), F.lit(1).alias("ordinal"))
    return I.merge(base.select("item_id", "title"), cleaned, meta, key="item_id").select("item_id", "title", "clean_title", F.col("pet_species").alias("species"))


@query(f"select p_partkey, p_type from (select *, count(*) over (partition by p_type) as n, row_number() over (partition by p_type order by {spread_sql('p_partkey', 42)}, p_partkey) as rn from part) where rn <= case when n * 0.35::double < 3 then 3 else floor(n * 0.35::double) end", views=False)
def stratified_sample(spark, sf):
    return I.sample_by_category(table(spark, sf, "part").select("p_partkey", "p_type"), spread("p_partkey", 42), 0.35, 3, "p_type", "p_partkey")


_SPECIES = ["dog", "cat, dog", "ant", "rabbit", "turtle", "all", "wolf", "ferret,dog", None]
_STAGES = ["puppy", "young", "adult,senior", "puppy, adult", "kitten,puppy", "small", "old", "puppy,kitten,adult,senior", None]


def _sql_list(values):
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col("p_partkey") % len(values)).cast("int"))


@query(
    f"""select p_partkey, case when v is null then null when m in ('dog', 'cat', 'fish', 'bird', 'small_animal', 'reptile', 'horse', 'other') then m else 'other' end as species from (select p_partkey, v,
    case when f in ('rabbit', 'ferret') then 'small_animal' when f = 'turtle' then 'reptile' when f in ('ant', 'frog', 'hermit_crab', 'pig', 'chicken', 'goat', 'poultry', 'insect', 'all') then 'other' else f end as m
    from (select p_partkey, v, trim(split_part(v, ',', 1)) as f from (select p_partkey, {_sql_list(_SPECIES)}[p_partkey % {len(_SPECIES)} + 1] as v from part)))""",
    views=False,
)
def pet_species_norm(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.species(_pick(_SPECIES)).alias("species"))


@query(
    f"""with m as (select map(['baby', 'newborn', 'foal', 'young', 'growing', 'juvenile', 'juveniles', 'kitten,puppy', 'puppy,kitten', 'small', 'adult,senior', 'senior,all', 'puppy,kitten,adult,senior'],
    ['puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'puppy', 'senior', 'senior', 'all']) as t),
    a as (select p_partkey, t, case when contains(v, ',') then coalesce(t[v], trim(split_part(v, ',', 1))) else v end as f from (select p_partkey, {_sql_list(_STAGES)}[p_partkey % {len(_STAGES)} + 1] as v from part), m),
    b as (select p_partkey, coalesce(t[f], f) as g from a) select p_partkey, case when g in ('puppy', 'kitten', 'adult', 'senior', 'all') then g end as stage from b""",
    views=False,
)
def life_stage_norm(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.life_stage(_pick(_STAGES)).alias("stage"))


@query("select p_type, count(*) as n from part group by 1 order by n desc, p_type", views=False)
def value_counts(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


# ---- text

@query("""select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed, length(text) as n_chars, len(string_split(text, ' ')) as n_words, array_to_string(string_split(text, ' ')[1:6], ' ') as prefix,
    array_to_string(string_split(text, ' ')[greatest(len(string_split(text, ' ')) // 2 - 2, 0) + 1:greatest(len(string_split(text, ' ')) // 2 - 2, 0) + 4], ' ') as middle from documents""", views=False)
def text_functions(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.squeeze(t).alias("squeezed"), F.length(t).cast("long").alias("n_chars"), F.size(X.words(t)).cast("long").alias("n_words"), X.prefix_words(t).alias("prefix"), X.middle_words(t).alias("middle"))


_TOK = """list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '["()\\[\\]{{}}<>]', ' ', 'g'), '([.,!?;:])\\s', ' \\1 ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"""


def _pairs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("pred"), F.expr("substring(text, 41)").alias("gold"))


_PAIRS = "(select doc_id, text as pred, substr(text, 41) as gold from documents)"


@query(
    f"""select doc_id, case when len(p) = 0 or len(g) = 0 or len(list_intersect(p, g)) = 0 then 0.0 else round(2.0 * len(list_intersect(p, g)) / (len(p) + len(g)), 6) end as f1
    from (select doc_id, list_distinct({_TOK.format(c='pred')}) as p, list_distinct({_TOK.format(c='gold')}) as g from {_PAIRS})""",
    views=False,
)
def token_f1(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(A.set_f1(X.tokens(F.col("pred")), X.tokens(F.col("gold"))), 6).alias("f1"))


@query(
    f"""select doc_id, case when len(u) = 0 then 1.0 else round(len(list_intersect(p, g)) / len(u)::double, 6) end as jaccard from (select *, list_distinct(list_concat(p, g)) as u from
    (select doc_id, list_distinct(regexp_extract_all(lower(pred), '[a-z0-9]+')) as p, list_distinct(regexp_extract_all(lower(gold), '[a-z0-9]+')) as g from {_PAIRS}))""",
    views=False,
)
def token_jaccard(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(A.jaccard(X.alnum_words(F.col("pred")), X.alnum_words(F.col("gold"))), 6).alias("jaccard"))


@query(
    f"""select doc_id, case when length(a) = 0 and length(b) = 0 then 1.0 when length(a) = 0 or length(b) = 0 or c = 0 then 0.0 else round(2.0 * c / (length(a) + length(b)), 6) end as f1 from (select *,
    list_sum(list_transform(list_distinct(regexp_extract_all(a, '.')), lambda ch: least(length(a) - length(replace(a, ch, '')), length(b) - length(replace(b, ch, ''))))) as c
    from (select doc_id, regexp_replace(lower(pred), '\\s+', '', 'g') as a, regexp_replace(lower(gold), '\\s+', '', 'g') as b from {_PAIRS}))""",
    views=False,
)
def char_f1(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(A.char_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query()
def rouge_l(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(statistics.rouge_l(X.tokens(F.col("pred")), X.tokens(F.col("gold"))), 6).alias("f1"))


@query()
def hashed_ngram_cosine(spark, sf):
    return statistics.hashed_cosine(_pairs(spark, sf), "pred", "gold").select("doc_id", F.round("cosine", 6).alias("cosine"))


@query("select a.p_partkey as p_partkey, case when lower(a.p_type) <> lower(b.p_type) then 0 when lower(a.p_brand) <> lower(b.p_brand) then 1 else 2 end as depth from part a join part b on b.p_partkey = a.p_partkey + 1", views=False)
def category_depth(spark, sf):
    path = F.concat("p_type", F.lit(" > "), "p_brand")
    a = table(spark, sf, "part").select("p_partkey", path.alias("x"))
    b = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(path).alias("y"))
    return a.join(b, "p_partkey").select("p_partkey", X.category_depth(F.col("x"), F.col("y")).alias("depth"))


# ---- identifiers

_SID = "item_id, A, B, C, D"


@query(f"select {_SID} from sids")
def sid_assign_d(spark, sf):
    return sids(spark, sf).select("item_id", *semantic_ids.LEVELS)


@query("select item_id, sid from sids")
def sid_tokens(spark, sf):
    return sids(spark, sf).select("item_id", "sid")


@query("select item_id, A::varchar as a, B::varchar as b, C::varchar as c, D::varchar as d, sid as token, 2::bigint as n_all from sids")
def sid_parse_roundtrip(spark, sf):
    t = F.concat(F.lit("see "), F.col("sid"), F.lit(" and "), F.col("sid"), F.lit("."))
    rows = sids(spark, sf).select("item_id", semantic_ids.parse(t).alias("s"), semantic_ids.parse_token(t).alias("token"), F.size(semantic_ids.parse_all(t)).cast("long").alias("n_all"))
    return rows.select("item_id", F.col("s.A").alias("a"), F.col("s.B").alias("b"), F.col("s.C").alias("c"), F.col("s.D").alias("d"), "token", "n_all")


@query("select sum(n)::bigint as n_items, count(*) as n_unique, round(sum(case when n > 1 then n else 0 end) / sum(n)::double, 6) as collision_share, max(n) as max_bucket from (select count(*) as n from sids group by A, B, C)")
def sid_collisions(spark, sf):
    return semantic_ids.collisions(sids(spark, sf))


@query("select level, count(*) as used, 256 - count(*) as dead, round(exp(-sum(p * ln(p + 1e-12))), 6) as perplexity, round(max(p), 6) as top_share from (select level, n / sum(n) over (partition by level)::double as p from (select level, code, count(*) as n from (select 'A' as level, A as code from sids union all select 'B', B from sids union all select 'C', C from sids) group by all)) group by level")
def codebook_level_stats(spark, sf):
    return semantic_ids.level_stats(sids(spark, sf))


@query("select round(count(distinct (A, B, C)) / count(*)::double, 6) as unique_share from sids")
def unique_id_share(spark, sf):
    return sids(spark, sf).agg(F.round(F.count_distinct(F.struct("A", "B", "C")) / F.count("*"), 6).alias("unique_share"))


@query("select * from (values (0, '<|sid_start|>'), (1, '<|sid_end|>'), (2, '<|rec|>')) v(token_id, token) union all select (i + 3)::int, '<|' || substr('ABCD', i // 256 + 1, 1) || (i % 256) || '|>' from (select unnest(range(1024))::int as i)", views=False)
def sid_vocabulary(spark, sf):
    return semantic_ids.vocabulary(spark)


# ---- samples

_SAMPLE_SQL = {
    "sid_to_title": "select 'Product ' || sid || ' has title:' as instruction, coalesce(title, '') as output from sids",
    "sid_to_description": "select 'Item ' || sid || ' is described as:' as instruction, description_text as output from sids where length(description_text) >= 1",
    "sid_to_category": "select 'Product ' || sid || ' belongs to category:' as instruction, categories_text as output from sids where length(categories_text) >= 1",
    "sid_to_context": "select 'Tell me about product ' || sid || ':' as instruction, 'Title: ' || title || ' Description: ' || coalesce(description_text, '') || ' Category: ' || categories_text as output from sids",
    "sid_to_features": "select 'Product ' || sid || ' features:' as instruction, features_text as output from sids where length(features_text) >= 1",
    "title_to_sid": "select 'The product \"' || title || '\" has SemanticID:' as instruction, sid as output from sids",
    "title_prefix_to_sid": "select 'A product titled \"' || array_to_string(string_split(title, ' ')[1:6], ' ') || '\" has SemanticID:' as instruction, sid as output from sids where len(string_split(title, ' ')) >= 3",
    "title_contains_to_sid": "select 'A product with \"...' || array_to_string(w[greatest(len(w) // 2 - 2, 0) + 1:greatest(len(w) // 2 - 2, 0) + 4], ' ') || '...\" in its title has SemanticID:' as instruction, sid as output from (select sid, string_split(title, ' ') as w from sids) where len(w) >= 8",
    "description_to_sid": "select 'A product described as \"' || substr(description_text, 1, 250) || '...\" has SemanticID:' as instruction, sid as output from sids where length(description_text) >= 50",
    "description_contains_to_sid": "select 'A product with description containing \"...' || substr(description_text, i + 1, 50) || '...\" has SemanticID:' as instruction, sid as output from sids, (select unnest([50, 100, 200]) as i) where length(description_text) >= greatest(120, i + 60) and length(trim(substr(description_text, i + 1, 50))) >= 10",
    "features_to_sid": "select 'A Pet_Supplies product with features \"' || substr(features_text, 1, 400) || '\" has SemanticID:' as instruction, sid as output from sids where length(features_text) >= 20",
    "seq_last_2": "select 'User''s last purchases: ' || sid_sequence[k - 1] || ', ' || sid_sequence[k] || '. Next:' as instruction, sid_sequence[k + 1] as output from (select sid_sequence, unnest(range(2, len(sid_sequence))) as k from sid_sequences)",
    "seq_last_3": "select 'Based on recent purchases: ' || array_to_string(sid_sequence[k - 2:k], ', ') || ', next item:' as instruction, sid_sequence[k + 1] as output from (select sid_sequence, unnest(range(3, len(sid_sequence))) as k from sid_sequences)",
    "seq_last_5": "select 'Purchase sequence: ' || array_to_string(sid_sequence[k - 4:k], ', ') || '. Predict next:' as instruction, sid_sequence[k + 1] as output from (select sid_sequence, unnest(range(5, len(sid_sequence))) as k from sid_sequences)",
    "similar_products_ab": "select 'Products similar to ' || base || ' include:' as instruction, array_to_string(list_filter(s, lambda x: x <> base)[1:5], ', ') as output from (select s, unnest(s[1:6]) as base from (select list(sid order by sid) as s from sids group by A, B having count(*) >= 2))",
    "prefix_category": "select 'Products starting with prefix A=' || A || ' are typically:' as instruction, cat || ' products' as output from (select A, cat, sum(n) over (partition by A) as total, row_number() over (partition by A order by n desc, cat) as rn from (select A, store as cat, count(*) as n from sids group by all)) where rn = 1 and total >= 5",
    "prefix_examples": "select 'Examples of products with prefix A=' || A || ':' as instruction, array_to_string(list(sid order by sid)[1:3], ', ') as output from sids group by A having count(*) >= 5",
    "prefix_2level_category": "select 'Products starting with prefix A=' || A || ', B=' || B || ' are:' as instruction, cat || ' items' as output from (select A, B, cat, sum(n) over (partition by A, B) as total, row_number() over (partition by A, B order by n desc, cat) as rn from (select A, B, store as cat, count(*) as n from sids group by all)) where rn = 1 and total >= 3",
    "copurchase_forward": "select 'A user who bought ' || i || ' (' || t.title || ') might also buy:' as instruction, j as output from (PAIRS4) join sids t on t.sid = i",
    "copurchase_backward": "select 'Before buying ' || j || ' (' || t.title || '), users often buy:' as instruction, i as output from (PAIRS4) join sids t on t.sid = j",
    "category_transition": "select 'After buying from ' || a || ', users often buy from:' as instruction, b as output from (select a, b from (select cat as a, lead(cat) over (partition by user_id order by pos) as b from (select user_id, unnest(sid_sequence) as sid, generate_subscripts(sid_sequence, 1) as pos from sid_sequences) join (select sid, store as cat from sids) using (sid)) where b is not null group by a, b having count(*) >= 5)",
    "frequently_bought_together": "select 'Items frequently bought together: ' || i || ' and:' as instruction, j as output from (select i, j, count(*) as n from (PAIRS2) group by i, j having count(*) >= 3 order by n desc, i, j limit 500)",
    "sequence_length_example": "select 'Example of a ' || k || '+ item purchase sequence:' as instruction, array_to_string(sid_sequence[1:k], ', ') as output from (select k, sid_sequence, row_number() over (partition by k order by user_id) as rn from sid_sequences, (select unnest([3, 5, 10, 20]) as k) where len(sid_sequence) >= k) where rn <= 10",
}
for _w, _d in (("PAIRS4", "distinct"), ("PAIRS2", "")):
    _p = f"select {_d} sid_sequence[k] as i, sid_sequence[k + o] as j from (select sid_sequence, unnest(range(1, len(sid_sequence))) as k from sid_sequences), (select unnest(range(1, {int(_w[-1]) + 1})) as o) where k + o <= len(sid_sequence)"
    _SAMPLE_SQL = {k: v.replace(_w, _p) for k, v in _SAMPLE_SQL.items()}


def _name(column: str) -> F.Column:
    return packed_token(F.col(column))


def _coded_items(spark, sf):
    return sids(spark, sf).withColumn("sid", packed_code())


def _generator(f):
    def run(spark, sf):
        if f in (S.copurchase_forward, S.copurchase_backward):
            return f(code_sequences(spark, sf), _coded_items(spark, sf), _name)
        if f is S.frequently_bought_together:
            return f(code_sequences(spark, sf), _name)
        if f is S.category_transition:
            return f(code_sequences(spark, sf), _coded_items(spark, sf))
        if f in S.FROM_ITEMS:
            return f(sids(spark, sf))
        return f(sid_sequences(spark, sf)) if f in S.FROM_SEQUENCES else f(sid_sequences(spark, sf), sids(spark, sf))

    return run


for _f in S.FROM_ITEMS + S.FROM_SEQUENCES + S.FROM_BOTH:
    query(f"select instruction, output, '{_f.__name__}' as type from ({_SAMPLE_SQL[_f.__name__]})", name=f"gen_{_f.__name__}")(_generator(_f))

_UNION = "(" + " union all ".join(f"select instruction, output, '{k}' as type from ({v})" for k, v in _SAMPLE_SQL.items()) + ")"


@query(f"select type, count(*) as n, count(distinct instruction) as n_instructions from {_UNION} where length(instruction) > 0 and length(output) > 0 group by type")
def type_distribution(spark, sf):
    return S.type_counts(sids(spark, sf), sid_sequences(spark, sf), _coded_items(spark, sf), code_sequences(spark, sf), _name)


_SOME = "(select 'x' || (o_custkey % 200) as instruction, o_orderpriority as output, case o_orderkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as type, o_orderkey from orders)"


def _some(spark, sf):
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(F.concat(F.lit("x"), (F.col("o_custkey") % 200).cast("string")).alias("instruction"), F.col("o_orderpriority").alias("output"), F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("type"), "o_orderkey")


@query(f"select [{{'role': 'system', 'content': 's'}}, {{'role': 'user', 'content': instruction}}, {{'role': 'assistant', 'content': output}}] as conversations, type from {_SOME}", views=False)
def conversations_chat(spark, sf):
    return S.conversations(_some(spark, sf), "s")


@query(
    f"""with s as (select *, row_number() over (order by {spread_sql('o_orderkey', 42)}, o_orderkey) <= (select floor(count(*) * 0.05) from orders) as v from {_SOME}),
    a as (select distinct type, instruction, output from s where v), b as (select distinct type, instruction, output, 1 as k from s where not v)
    select type, count(*) as n_val, count(k) as n_overlap, round(count(k) / count(*)::double, 6) as ratio from a left join b using (type, instruction, output) group by type""",
    views=False,
)
def leakage_overlap(spark, sf):
    rows = sequences.split_exact(_some(spark, sf), spread("o_orderkey", 42), ["o_orderkey"], 0.05, True)
    return S.leakage(rows.where("split = 'train'"), rows.where("split = 'val'"))


@query(f"select count(*) as n, round(avg(len(string_split(instruction, ' '))), 6) as avg_user, round(avg(len(string_split(output, ' '))), 6) as avg_assistant, sum(len(string_split(instruction, ' ')) + len(string_split(output, ' ')))::bigint as total_tokens, count(distinct instruction) as unique_user, count(distinct output) as unique_assistant from (select instruction, output from ({_SAMPLE_SQL['sid_to_title']}))")
def token_stats(spark, sf):
    return S.token_stats(S.sid_to_title(sids(spark, sf)))


@query("select col, count(*) as rows, max(len)::int as max_len, round(quantile_cont(len, 0.5), 6) as p50, round(quantile_cont(len, 0.9), 6) as p90, round(quantile_cont(len, 0.99), 6) as p99, count(*) filter (len > 1200) as over_1200, count(*) filter (len > 2000) as over_2000 from (select 'title' as col, length(coalesce(title, '')) as len from items union all select 'description_text', length(coalesce(description_text, '')) from items) group by col order by max_len desc, col")
def length_report(spark, sf):
    return S.length_report(items(spark, sf), ["title", "no_such_column", "description_text"])


@query(f"select o_orderkey, type from (select *, row_number() over (partition by type order by {spread_sql('o_orderkey', 42)}, instruction, output) as rn from {_SOME}) where rn <= case when type = 'b' then 7 else 100 end", views=False)
def per_task_sample(spark, sf):
    return S.per_task(_some(spark, sf), spread("o_orderkey", 42), 100, S.sample_sizes({"a": "sid_prediction", "b": "text_generation", "c": "other"}, 100, 7)).select("o_orderkey", "type")


_P2 = "select sid_sequence[k] as sid_i, sid_sequence[k + o] as sid_j from (select sid_sequence, unnest(range(1, len(sid_sequence))) as k from sid_sequences), (select unnest([1, 2]) as o) where k + o <= len(sid_sequence)"


@query("select distinct sid_sequence[k] as sid_i, sid_sequence[k + o] as sid_j from (select sid_sequence, unnest(range(1, len(sid_sequence))) as k from sid_sequences), (select unnest([1, 2, 3, 4]) as o) where k + o <= len(sid_sequence)")
def copurchase_pairs(spark, sf):
    return S.distinct_pairs(code_sequences(spark, sf), 4).select(_name("sid_i").alias("sid_i"), _name("sid_j").alias("sid_j"))


@query(f"select sid_i, sid_j, count(*) as n from ({_P2}) group by 1, 2 order by n desc, sid_i, sid_j limit 10")
def fbt_top(spark, sf):
    return S.bought_together(code_sequences(spark, sf), 1, 10, _name)


# ---- predictions

@query("""select task, sample_id, (coalesce(r, 99) <= 1)::int::double as hit1, (coalesce(r, 99) <= 5)::int::double as hit5, (coalesce(r, 99) <= 10)::int::double as hit10, round(coalesce(1.0 / r, 0), 6)::double as rr, round(coalesce(1.0 / log2(r + 1), 0), 6)::double as ndcg
    from (select task, sample_id, min(rk) filter (depth = 4) as r from ranked group by all)""")
def beam_per_sample(spark, sf):
    return ranking.beam_metrics(predictions(spark, sf)).withColumns({c: F.round(c, 6) for c in ("rr", "ndcg")})


@query("""select task, count(*) as n, round(avg((coalesce(r, 99) <= 1)::int), 6) as hit1, round(avg((coalesce(r, 99) <= 5)::int), 6) as hit5, round(avg((coalesce(r, 99) <= 10)::int), 6) as hit10, round(avg(coalesce(1.0 / r, 0)), 6) as rr, round(avg(coalesce(1.0 / log2(r + 1), 0)), 6) as ndcg
    from (select task, sample_id, min(rk) filter (depth = 4) as r from ranked group by all) group by task""")
def hit_mrr_ndcg(spark, sf):
    return ranking.beam_summary(predictions(spark, sf))


@query("""select task, ['A', 'AB', 'ABC', 'ABCD'][m] as level, round(avg((coalesce(r, 99) <= 5)::int), 6) as hit5, round(avg((coalesce(r, 99) <= 10)::int), 6) as hit10, round(avg(coalesce(1.0 / r, 0)), 6) as mrr10
    from (select task, sample_id, m, min(rk) filter (depth >= m) as r from ranked, (select unnest([1, 2, 3, 4]) as m) group by all) group by task, m""")
def hier_hits(spark, sf):
    return ranking.hierarchical_summary(predictions(spark, sf))


@query("select task, count(*) as n, round(avg((depth is not null)::int), 6) as valid_format, round(avg((coalesce(depth, -1) >= 1)::int), 6) as level_a, round(avg((coalesce(depth, -1) >= 2)::int), 6) as level_ab, round(avg((coalesce(depth, -1) >= 3)::int), 6) as level_abc, round(avg((coalesce(depth, -1) >= 4)::int), 6) as exact_match from ranked where rk = 1 group by task")
def greedy_levels(spark, sf):
    return ranking.greedy_summary(predictions(spark, sf))


@query("select verdict, count(*) as n from (select case when s is null then 'invalid_format' when gold is null then null when depth = 4 then 'correct' else ['A', 'B', 'C', 'D'][depth + 1] end as verdict from ranked where rk = 1) where verdict is not null group by verdict")
def first_wrong_level(spark, sf):
    return ranking.first_wrong_level(predictions(spark, sf))


@query("select gold.A as gold_a, s.A as pred_a, count(*) as n from ranked where rk = 1 and gold.A <> s.A group by 1, 2 order by n desc, gold_a, pred_a limit 20")
def level_a_confusion(spark, sf):
    return ranking.level_a_confusion(predictions(spark, sf))


@query("select side, a, n from (select *, row_number() over (partition by side order by n desc, a) as rn from (select side, a, count(*) as n from (select 'gold' as side, gold.A as a from ranked where rk = 1 union all select 'pred', s.A from ranked where rk = 1 and gold is not null) where a is not null group by all)) where rn <= 10")
def level_a_distribution(spark, sf):
    return ranking.level_a_distribution(predictions(spark, sf))


_T = "'<|sid_start|><|A' || {0}.A || '|><|B' || {0}.B || '|><|C' || {0}.C || '|><|D' || {0}.D || '|><|sid_end|>'"
_TS, _TG = _T.format("s"), _T.format("gold")
_KNOWN = "(select sid from sids where p_partkey % 3 <> 0)"


def _known(spark, sf):
    return sids(spark, sf).where("p_partkey % 3 <> 0").select("sid")


@query(f"select task, count(*) as n, count(*) filter (t is null) as n_invalid, round(avg((coalesce(t in {_KNOWN}, false))::int), 6) as hit_rate from (select task, {_TS} as t from ranked where rk = 1) group by task")
def catalog_hit(spark, sf):
    return ranking.catalog_hit(predictions(spark, sf), _known(spark, sf))


@query(f"with g as (select distinct {_TG} as t from ranked where gold is not null), b as (select task, sample_id, ({_TS} in (select t from g))::int as k from ranked where s is not null) select task, round(sum(s) / sum(c)::double, 6) as by_beam, round(avg(m), 6) as by_any from (select task, sample_id, sum(k) as s, count(*) as c, max(k) as m from b group by all) group by task")
def gold_catalog_hit(spark, sf):
    return ranking.gold_catalog_hit(predictions(spark, sf))


@query(f"select task, count(distinct {_TS}) as unique_sids, (select count(distinct sid) from sids) as catalog_size, round(count(distinct {_TS}) / (select count(distinct sid) from sids)::double, 6) as coverage from ranked where s is not null group by task")
def coverage_at_10(spark, sf):
    return ranking.coverage(predictions(spark, sf), sids(spark, sf))


_SIDES = "(select sid, n, case when rn <= greatest(floor(k * 0.2), 1) then 'head' when rn > k - greatest(floor(k * 0.2), 1) then 'tail' end as side from (select sid, n, row_number() over (order by n desc, sid) as rn, count(*) over () as k from (select sid, count(*) as n from (select unnest(sid_sequence) as sid from sid_sequences) group by sid)))"


@query(f"select sid, n, side from {_SIDES} where side is not null")
def head_tail_sets(spark, sf):
    return ranking.head_tail(sid_sequences(spark, sf))


_HITS = f"(select task, any_value({_TG}) as sid, (count(*) filter (depth = 4) > 0)::int as h from ranked where gold is not null group by task, sample_id)"


@query(f"select task, side, count(*) as n, round(avg(h), 6) as recall10 from {_HITS} join {_SIDES} using (sid) where side is not null group by task, side")
def stratified_recall(spark, sf):
    return ranking.stratified_recall(predictions(spark, sf), ranking.head_tail(sid_sequences(spark, sf)))


@query(f"select task, case when c >= 2 then 'head' else 'tail' end as side, count(*) as n, round(avg(h), 6) as recall10 from (select *, count(*) over (partition by task, sid) as c from {_HITS}) group by 1, 2")
def recall_by_gold_copies(spark, sf):
    return ranking.recall_by_gold_copies(predictions(spark, sf))


@query(f"select count(*) as total, count(*) filter (t is null) as invalid_format, count(*) filter (t is not null and t not in {_KNOWN}) as hallucinated, round(count(*) filter (t is not null and t not in {_KNOWN}) / greatest(count(t), 1)::double, 6) as hallucination_rate from (select {_TS} as t from ranked where rk = 1)")
def hallucination(spark, sf):
    return ranking.hallucination(predictions(spark, sf), _known(spark, sf))


@query(f"with c as (select t, count(*) as n from (select {_TS} as t from ranked where rk = 1) where t is not null group by t) select sum(n)::bigint as total, count(*) as unique_sids, round(count(*) / sum(n)::double, 6) as unique_rate, round((select sum(n) from (select n from c order by n desc, t limit 5)) / sum(n)::double, 6) as top5_share, round(count(*) / (select count(distinct sid) from sids)::double, 6) as exploration from c")
def diversity(spark, sf):
    return ranking.diversity(predictions(spark, sf), sids(spark, sf))


_INTENTS = (("metal", "steel copper tin nickel"), ("size", "small large medium economy"), ("text", "the de en"))


def _named(spark, sf):
    return sids(spark, sf).withColumn("name", F.concat("main_category", F.lit(" "), "title"))


_PAIRS_OF = ", ".join(f"('{w}', '{to}')" for w, to in X.keyword_pairs(_INTENTS))


@query(f"select A, intent, n from (select A, intent, n, row_number() over (partition by A order by n desc, intent) as rn from (select A, intent, count(*) as n from sids, (values {_PAIRS_OF}) v(w, intent) where contains(lower(main_category || ' ' || title), w) group by A, intent)) where rn = 1 and n >= 3")
def dominant_intent(spark, sf):
    return ranking.dominant_intent(_named(spark, sf), _INTENTS, title="name")


@query(f"""with d as (select A::int as a, intent from (select A, intent, n, row_number() over (partition by A order by n desc, intent) as rn from (select A, intent, count(*) as n from sids, (values {_PAIRS_OF}) v(w, intent) where contains(lower(main_category || ' ' || title), w) group by A, intent)) where rn = 1 and n >= 3),
    q as (select case when contains(task, 'tin') then 'metal' when contains(task, 'de') then 'text' when contains(task, 'en') then 'text' end as want, s.A::int as a from ranked where rk = 1 and s is not null)
    select count(*) as n, count(*) filter (want = intent) as matched, round(avg((want = intent)::int), 6) as rate from q join d using (a) where want is not null""")
def intent_match(spark, sf):
    dominant = ranking.dominant_intent(_named(spark, sf), _INTENTS, title="name")
    return ranking.intent_match(predictions(spark, sf), F.col("task"), dominant, _INTENTS)


_GOLDS = f"(select task, sample_id, list_distinct([any_value({_TG}), any_value({_TS}) filter (rk = 7), 'x']) as g from ranked where gold is not null group by all)"


@query(f"""select task, count(*) as n, round(avg((coalesce(r, 99) <= 1)::int), 6) as hit1, round(avg((coalesce(r, 99) <= 5)::int), 6) as hit5, round(avg((coalesce(r, 99) <= 10)::int), 6) as hit10, round(avg(coalesce(1.0 / r, 0)), 6) as mrr10, round(avg(c), 6) as coverage10
    from (select task, sample_id, min(rk) filter (list_contains(g, t)) as r, count(distinct t) filter (list_contains(g, t)) / len(any_value(g))::double as c from (select task, sample_id, rk, {_TS} as t from ranked where gold is not null) join {_GOLDS} using (task, sample_id) group by all) group by task""")
def multi_gold(spark, sf):
    p = predictions(spark, sf).where("gold is not null")
    golds = F.array_compact(F.array(ranking.as_token(F.col("gold")), ranking.as_token(F.get("beams", F.lit(6))), F.lit("x")))
    return ranking.multi_gold(p.select("task", "sample_id", golds.alias("golds"), F.transform("beams", ranking.as_token).alias("beams")))


_NEAREST = " + ".join(f"(coalesce(s.A = {g}.A, false){''.join(f' and s.{x} = {g}.{x}' for x in up)})::int" for g in ("GOLD",) for up in ("", "B", "BC", "BCD"))


@query(f"""select task, count(*) as n, round(avg((d is not null)::int), 6) as valid_format, round(avg((coalesce(d, -1) >= 1)::int), 6) as level_a, round(avg((coalesce(d, -1) >= 2)::int), 6) as level_ab, round(avg((coalesce(d, -1) >= 3)::int), 6) as level_abc, round(avg((coalesce(d, -1) >= 4)::int), 6) as exact_match
    from (select task, case when s is not null then greatest({_NEAREST.replace("GOLD", "gold")}, coalesce({_NEAREST.replace("GOLD", "other")}, 0)) end as d from ranked join (select task as t3, sample_id as i3, s as other from ranked where rk = 7) on t3 = task and i3 = sample_id where rk = 1 and gold is not null) group by task""")
def multi_gold_greedy(spark, sf):
    p = predictions(spark, sf).where("gold is not null")
    return ranking.multi_gold_greedy(p.select("task", F.get("beams", F.lit(0)).alias("pred"), F.array_compact(F.array("gold", F.get("beams", F.lit(6)))).alias("golds")))


@query("select task, sample_id, correct from (select task, sample_id, correct, row_number() over (partition by task, correct order by sample_id) as rn from (select task, sample_id, coalesce(depth = 4, false) as correct from ranked where rk = 1)) where rn <= 3")
def qualitative_examples(spark, sf):
    return ranking.examples(predictions(spark, sf))


@query("""select grp, sum(n)::bigint as n, round(sum(hit10 * n) / sum(n), 6) as hit10 from (select task, count(*) as n, round(avg(h), 6) as hit10 from (select task, sample_id, (count(*) filter (depth = 4) > 0)::int as h from ranked group by all) group by task)
    join (values ('seq_last_2', 'collaborative'), ('copurchase_forward', 'collaborative'), ('title_to_sid', 'text')) g(task, grp) using (task) group by grp""")
def weighted_groups(spark, sf):
    groups = spark.createDataFrame([("seq_last_2", "collaborative"), ("copurchase_forward", "collaborative"), ("title_to_sid", "text")], "task string, grp string")
    return ranking.weighted(ranking.beam_summary(predictions(spark, sf)), groups, "hit10")


# ---- statistics

@query("select event_type, user_id, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as n_seeds from events group by all", views=False)
def mean_std_over_seeds(spark, sf):
    return statistics.over_seeds(table(spark, sf, "events"), ["event_type", "user_id"], "value")


@query("select event_type, round(avg(m), 6) as value, count(*) as n_tasks from (select event_type, user_id, avg(value) as m from events group by all) group by event_type", views=False)
def macro_average(spark, sf):
    return statistics.macro_average(table(spark, sf, "events"), ["event_type"], "user_id", "value")


@query("select event_type, sum(user_id)::bigint as tokens, round(exp(sum(value) / sum(user_id)), 6) as perplexity from events group by event_type", views=False)
def perplexity(spark, sf):
    return statistics.perplexity(table(spark, sf, "events").select("event_type", F.col("value").alias("nll"), F.col("user_id").alias("tokens")), ["event_type"])


@query()
def bootstrap_ci(spark, sf):
    return statistics.bootstrap_ci(ranking.beam_metrics(predictions(spark, sf)), "task", "hit10")


@query()
def paired_bootstrap(spark, sf):
    return statistics.paired_bootstrap(ranking.beam_metrics(predictions(spark, sf)), "task", "sample_id", "hit5", "hit10")


@query()
def coverage_bootstrap(spark, sf):
    p = predictions(spark, sf)
    tokens = F.filter(F.transform("beams", ranking.as_token), lambda x: x.isNotNull())
    rows = p.select("task", "sample_id", F.slice(tokens, 1, 3).alias("a"), tokens.alias("b"))
    return statistics.coverage_bootstrap(rows, "task", "sample_id", "a", "b", table(spark, sf, "part").count())


# ---- vectors

def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


_V = "(select vec_id, label, embedding::double[] as v from embeddings)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


@query(f"select query, neighbour, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query order by round(score, 12) desc, neighbour) as rank from (select a.vec_id as query, b.vec_id as neighbour, list_cosine_similarity(a.v, b.v) as score from {_V} a join {_V} b on a.vec_id <> b.vec_id)) where rank <= 5", views=False)
def knn_topk(spark, sf):
    return vectors.knn(_vectors(spark, sf), _vectors(spark, sf), 5).withColumn("score", F.round("score", 6))


@query(
    f"""with k as (select query, neighbour, row_number() over (partition by query order by round(s, 12) desc, neighbour) as x, row_number() over (partition by query order by round(r, 12) desc, neighbour) as y from (select a.vec_id as query, b.vec_id as neighbour, list_inner_product(a.v, b.v) as s, list_cosine_similarity(a.v[1:32], b.v[1:32]) as r from {_V} a join {_V} b on a.vec_id <> b.vec_id))
    select count(distinct query) as n, round(count(*) filter (x <= 10 and y <= 10) / 10.0 / count(distinct query), 6) as overlap from k""",
    views=False,
)
def nn_overlap(spark, sf):
    v = _vectors(spark, sf)
    half = v.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return vectors.overlap_at_k(vectors.knn(v, v, 10, normalize=False), vectors.knn(half, half, 10))


@query(f"select label, count(*) as n, round(avg(c), 6) as mean, round(quantile_cont(c, 0.1), 6) as p10, round(quantile_cont(c, 0.5), 6) as p50, round(quantile_cont(c, 0.9), 6) as p90, round(avg(m), 6) as mse from (select a.label, list_cosine_similarity(a.v, b.v) as c, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) ** 2)) / 64 as m from {_V} a join {_V} b on b.vec_id = a.vec_id + 1) group by label", views=False)
def cosine_stats(spark, sf):
    a = _vectors(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = a.join(b, "vec_id").select("label", A.cosine(F.col("embedding"), F.col("other")).alias("c"), (A.squared_distance(F.col("embedding"), F.col("other")) / F.size("embedding")).alias("m"))
    q = lambda p, n: F.round(F.percentile("c", F.lit(p)), 6).alias(n)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), q(0.1, "p10"), q(0.5, "p50"), q(0.9, "p90"), F.round(F.avg("m"), 6).alias("mse"))


def _codebook(spark, sf, levels=3, size=16):
    """The first vectors as codewords, halved at each level; of fixed size."""
    rows = _vectors(spark, sf).where(F.col("vec_id") < levels * size).orderBy("vec_id").select("embedding").collect()
    return [[[x / 2**k for x in rows[k * size + j][0]] for j in range(size)] for k in range(levels)]


@query(f"select a.vec_id as vec_id, arg_min(b.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) ** 2)), 12) + b.vec_id * 1e-15)::int as code from {_V} a, {_V} b where b.vec_id < 16 group by a.vec_id", views=False)
def nearest_code(spark, sf):
    return semantic_ids.quantize(_vectors(spark, sf), _codebook(spark, sf, 1), "vec_id", "embedding").select("vec_id", F.get("codes", F.lit(0)).alias("code"))


@query()
def residual_codes(spark, sf):
    q = semantic_ids.quantize(_vectors(spark, sf), _codebook(spark, sf), "vec_id", "embedding")
    return q.select("vec_id", "codes", F.round(A.dot(F.col("residual"), F.col("residual")), 6).alias("left"))


@query()
def prefix_coincidence(spark, sf):
    v = _vectors(spark, sf)
    return vectors.prefix_coincidence(vectors.knn(v, v, 10), semantic_ids.quantize(v, _codebook(spark, sf), "vec_id", "embedding"), 3, spread("vec_id", 5))


_WORDS = "(select vec_id // 16 as level, (vec_id % 16)::int as code, list_transform(v, lambda x: x / 2 ** (vec_id // 16)) as w from (select vec_id, embedding::double[] as v from embeddings) where vec_id < 48)"


@query(f"with b as {_WORDS} select e.vec_id as vec_id, list_transform(range(1, 65), lambda i: round(x.w[i] + y.w[i] + z.w[i], 9)) as decoded from (select vec_id, vec_id % 16 as i, (vec_id * 7) % 16 as j, (vec_id * 3 + 1) % 16 as k from embeddings) e join b x on x.level = 0 and x.code = i join b y on y.level = 1 and y.code = j join b z on z.level = 2 and z.code = k", views=False)
def decoded_codes(spark, sf):
    k = F.col("vec_id")
    codes = F.array((k % 16).cast("int"), (k * 7 % 16).cast("int"), ((k * 3 + 1) % 16).cast("int"))
    out = _vectors(spark, sf).select("vec_id", semantic_ids.decode(codes, _codebook(spark, sf)).alias("v"))
    return out.select("vec_id", F.transform("v", lambda x: F.round(x, 9)).alias("decoded"))


@query(f"""with d as (select 1 - list_cosine_similarity(a.v, b.v) as x, 1 - list_cosine_similarity(a.v[1:32], b.v[1:32]) as y from {_V} a join {_V} b on a.vec_id < b.vec_id),
    r as (select x, y, rank() over (order by round(x, 12)) + (count(*) over (partition by round(x, 12)) - 1) / 2.0 as rx, rank() over (order by round(y, 12)) + (count(*) over (partition by round(y, 12)) - 1) / 2.0 as ry from d)
    select count(*) as pairs, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r""", views=False)
def rsa_corr(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.col("embedding").alias("a"), F.slice("embedding", 1, 32).alias("b"))
    return vectors.rsa(v, "a", "b", "vec_id")


@query()
def spectrum(spark, sf):
    v = _vectors(spark, sf).select("embedding", F.slice("embedding", 1, 32).alias("half"))
    return spark.createDataFrame([("effective_rank", round(vectors.effective_rank(v, "embedding"), 6)), ("linear_cka", round(vectors.cka(v, "embedding", "half"), 6))], "name string, value double")


@query()
def kmeans_codes(spark, sf):
    from pyspark.ml.functions import array_to_vector

    model = vectors.kmeans(_vectors(spark, sf), "embedding", 8)
    return model.transform(_vectors(spark, sf).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))).select("vec_id", F.col("prediction").alias("code"))


# ---- validation

def _gate(name, value, ok, warn, higher=True):
    op = ">=" if higher else "<"
    return f"select '{{t}}' as tbl, '{name}' as item, round(({value})::double, 6) as value, case when {value} {op} {ok} then 'OK' when {value} {op} {warn} then 'WARN' else 'FAIL' end as verdict from {{f}}"


_REPORT = " union all ".join(
    [_gate(n, v, a, b, h).format(t="items", f="items") for n, v, a, b, h in (("rows", "count(*)", 1500, 100, True), ("surplus_keys", "count(*) - count(distinct item_id)", 1, 1, False), ("null_title", "count(*) filter (title is null)", 1, 1, False), ("short_titles", "count(*) filter (length(title) <= 50)", 1, 1, False), ("short_descriptions", "count(*) filter (length(description_text) <= 500)", 1, 1, False), ("few_ratings", "count(*) filter (rating_number < 20)", 1, 1, False))]
    + [_gate(n, v, a, b, h).format(t="sequences", f="user_sequences") for n, v, a, b, h in (("rows", "count(*)", 100, 100, True), ("min_len", "min(seq_len)", 5, 5, True), ("surplus_users", "count(*) - count(distinct user_id)", 1, 1, False))]
    + [_gate("description_text", "1 - avg((description_text is null)::int)", 0.7, 0.4).format(t="metadata", f="items")]
)


@query(_REPORT)
def validation_report(spark, sf):
    return quality.union([quality.items_report(items(spark, sf), enough=1500, few=100), quality.sequences_report(user_sequences(spark, sf), enough=100), quality.fill_rates(items(spark, sf), ["description_text"])])


@query("select count(*) as n_sequences, count(*) filter (b) as n_with_unknown, round(1 - count(*) filter (b) / count(*)::double, 6) as coverage from (select user_id, bool_or(item_id not in (select item_id from items where p_partkey % 500 <> 0)) as b from numbered group by user_id)")
def unknown_items(spark, sf):
    return quality.unknown_items(user_sequences(spark, sf), items(spark, sf).where("p_partkey % 500 <> 0"))


# ---- further forms of the operators above

@query("select 'count' as stat, count(p_size)::double as p_size, count(p_retailprice)::double as p_retailprice from part union all select 'mean', round(avg(p_size), 6), round(avg(p_retailprice), 6) from part union all select 'stddev', round(stddev_samp(p_size), 6), round(stddev_samp(p_retailprice), 6) from part union all select 'min', min(p_size), min(p_retailprice) from part union all select 'max', max(p_size), max(p_retailprice) from part", views=False)
def describe_numeric(spark, sf):
    columns = ["p_size", "p_retailprice"]
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one = table(spark, sf, "part").agg(*(F.round(f(c).cast("double"), 6).alias(f"{s}_{c}") for s, f in stats.items() for c in columns))
    rows = F.array(*(F.struct(F.lit(s).alias("stat"), *(F.col(f"{s}_{c}").alias(c) for c in columns)) for s in stats))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("select event_type as arm, (event_id % 10)::int as step, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as n_seeds from events group by all", views=False)
def learning_curve(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("arm"), (F.col("event_id") % 10).cast("int").alias("step"), "value")
    return statistics.over_seeds(e, ["arm", "step"], "value")


@query(f"select p_partkey from (select p_partkey, row_number() over (order by {spread_sql('p_partkey', 42)}, p_partkey) as rn from part) where rn <= 50 order by p_partkey", views=False)
def sample_then_sort(spark, sf):
    return table(spark, sf, "part").select("p_partkey").orderBy(spread("p_partkey", 42), "p_partkey").limit(50).orderBy("p_partkey")


@query("select item_id from (select distinct item_id from numbered except select item_id from items where p_partkey % 2 = 0)")
def set_difference(spark, sf):
    used = user_sequences(spark, sf).select(F.explode("sequence").alias("item_id")).distinct()
    return used.join(items(spark, sf).where("p_partkey % 2 = 0").select("item_id"), "item_id", "left_anti")


@query("select item_id from (select distinct item_id from numbered intersect select item_id from items where p_partkey % 2 = 0)")
def set_intersection(spark, sf):
    return user_sequences(spark, sf).select(F.explode("sequence").alias("item_id")).intersect(items(spark, sf).where("p_partkey % 2 = 0").select("item_id"))


@query("select user_id, bool_or(item_id in (select item_id from items where p_partkey % 100 = 0)) as any_of from numbered group by user_id")
def list_contains_any(spark, sf):
    flat = user_sequences(spark, sf).select("user_id", F.explode("sequence").alias("item_id"))
    some = items(spark, sf).where("p_partkey % 100 = 0").select("item_id", F.lit(True).alias("hit"))
    return flat.join(some, "item_id", "left").groupBy("user_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("any_of"))


@query("select conv_id, list({'role': role, 'content': text} order by turn) as conversations, count(*) as turns, sum(len(string_split(text, ' ')))::bigint as tokens from conversations group by conv_id", views=False)
def conversation_threads(spark, sf):
    c = table(spark, sf, "conversations").withColumn("tokens", F.size(X.words(F.col("text"))))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda t: t["m"]).alias("conversations"), F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))


@query("""select bucket, token, count(*) as n from (select bucket, unnest(w) as token from (select (k * 256 + code)::int as bucket, code, string_split(title, ' ') as w from (select 0 as k, A as code, title from sids union all select 1, B, title from sids union all select 2, C, title from sids union all select 3, D, title from sids)) where code < 256) group by all""")
def token_buckets(spark, sf):
    return semantic_ids.token_buckets(sids(spark, sf), X.words(F.col("title")))


@query("select a.item_id as item_id, a.title as title_a, b.title as title_b from sids a left join sids b on b.A = a.A and b.B = a.B and b.C = a.C and b.D = a.D + 1")
def two_lookups(spark, sf):
    a = sids(spark, sf).select("item_id", F.col("title").alias("title_a"), *semantic_ids.LEVELS)
    b = sids(spark, sf).select("A", "B", "C", (F.col("D") - 1).alias("D"), F.col("title").alias("title_b"))
    return a.join(b, list(semantic_ids.LEVELS), "left").select("item_id", "title_a", "title_b")


@query()
def descriptive_block(spark, sf):
    return statistics.paired_bootstrap(ranking.beam_metrics(predictions(spark, sf)), "task", "sample_id", "rr", "ndcg").select("task", "n", "delta", "lo", "hi")


@query()
def packed_sequences(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("shard"), F.sequence(F.lit(1), F.col("p_size")).alias("ids"))
    return statistics.packed(rows, "p_partkey", "ids", 64, shard="shard")


_RANKED = "('0x' || substr(md5('{seed}|' || type || '|' || instruction || '|' || output), 1, 7))::bigint"


def _conversation_sql(seed: int, frac: float) -> str:
    parts = " union all ".join(f"select instruction, output, '{k}' as type from ({_SAMPLE_SQL[k]})" for k in ("sid_to_title", "sid_to_category", "seq_last_3"))
    rank = _RANKED.format(seed=seed)
    return f"select instruction, output, type, position, case when position < (floor(n * {frac}))::bigint then 'val' else 'train' end as split from (select *, row_number() over (order by {rank}, type, instruction, output) - 1 as position, count(*) over () as n from ({parts}) where length(instruction) > 0 and length(output) > 0)"


@query(_conversation_sql(42, 0.05))
def conversations_split(spark, sf):
    made = S.union([S.sid_to_title(sids(spark, sf)), S.sid_to_category(sids(spark, sf)), S.seq_last_3(sid_sequences(spark, sf))])
    return S.shuffled_split(made, 0.05, 42)


_CLEANED = """(select item_id, p_partkey, case when p_partkey % 40 = 0 then null when p_partkey % 41 = 0 then 'abc' else title end as clean_title, case when p_partkey % 150 = 0 then null else description_text end as clean_description,
    case when p_partkey % 11 <> 0 then [store] end as clean_features from items where p_partkey % 300 <> 1)"""


def _cleaned(spark, sf):
    k = F.col("p_partkey")
    columns = [F.when(k % 40 == 0, None).when(k % 41 == 0, "abc").otherwise(F.col("title")).alias("clean_title"), F.when(k % 150 != 0, F.col("description_text")).alias("clean_description"), F.when(k % 11 != 0, F.array("store")).alias("clean_features")]
    return items(spark, sf).where("p_partkey % 300 <> 1").select("item_id", "p_partkey", *columns)


_EXTRACTED = """(select item_id, p_partkey, main_category as product_type, case when p_partkey % 3 = 0 then 'dog' when p_partkey % 3 = 1 then 'wolf' end as pet_species, case when p_partkey % 2 = 0 then 'adult' end as life_stage, case when p_partkey % 5 = 0 then 'play' end as primary_use_case, case when p_partkey % 4 <> 0 then [store, 'steel'] end as material_or_active from items)"""


def _extracted(spark, sf):
    k = F.col("p_partkey")
    columns = [F.col("main_category").alias("product_type"), F.when(k % 3 == 0, "dog").when(k % 3 == 1, "wolf").alias("pet_species"), F.when(k % 2 == 0, "adult").alias("life_stage"), F.when(k % 5 == 0, "play").alias("primary_use_case"), F.when(k % 4 != 0, F.array(F.col("store"), F.lit("steel"))).alias("material_or_active")]
    return items(spark, sf).select("*", *columns)


def _there(t, columns, lists):
    return " union all ".join([f"select '{t}' as tbl, 'column_{c}' as item, 1.0::double as value, 'OK' as verdict" for c in columns] + [f"select '{t}', 'list_{c}', 1.0, 'OK'" for c in lists])


def _kept(t, f, warn):
    return f"select '{t}' as tbl, 'kept_rows' as item, round(v, 6) as value, case when v > 1 then 'FAIL' when v >= 1 then 'OK' when v >= {warn} then 'WARN' else 'FAIL' end as verdict from (select (select count(*) from {f}) / (select count(*) from items)::double as v)"


_INF = "1e300"


@query(" union all ".join([_kept("cleaned", _CLEANED, 1), _there("cleaned", quality.CLEAN, ("clean_features",))] + [_gate(f"null_{c}", f"avg(({c} is null)::int)", 0.01, 0.05, False).format(t="cleaned", f=_CLEANED) for c in quality.CLEAN] + [_gate("short_clean_titles", "count(*) filter (length(clean_title) < 5)", 1, _INF, False).format(t="cleaned", f=_CLEANED)]))
def cleaned_report(spark, sf):
    return quality.cleaned_report(_cleaned(spark, sf), items(spark, sf))


@query(" union all ".join([_kept("metadata", _EXTRACTED, 1), _there("metadata", quality.EXTRACTED, ("material_or_active",))] + [_gate(c, f"1 - avg(({c} is null)::int)", 0.7, 0.4).format(t="metadata", f=_EXTRACTED) for c in quality.EXTRACTED] + [_gate(f"odd_{c}", f"count(*) filter ({c} not in {known})", 1, _INF, False).format(t="metadata", f=_EXTRACTED) for c, known in (("pet_species", quality.SPECIES), ("life_stage", quality.STAGES))]))
def metadata_report(spark, sf):
    return quality.metadata_report(_extracted(spark, sf), items(spark, sf))


_ENRICHED = """'Title: ' || coalesce(title, '') || E'\\nDescription: ' || coalesce(description_text, '') || E'\\nCategory: ' || coalesce(categories_text, main_category, '') || E'\\nFeatures: ' || coalesce(features_text, '') || E'\\nPet Species: ' || coalesce(pet_species, 'N/A')
    || E'\\nProduct Type: ' || coalesce(product_type, 'N/A') || E'\\nLife Stage: ' || coalesce(life_stage, 'N/A') || E'\\nPrimary Use Case: ' || coalesce(primary_use_case, 'N/A') || E'\\nMaterial/Active: ' || coalesce(array_to_string(material_or_active, ', '), 'N/A')"""
_FULL = f"(select x.* exclude (p_partkey), i.* exclude (item_id) from items i join {_EXTRACTED} x using (item_id))"


@query(f"select item_id, {_ENRICHED} as item_context from {_FULL}")
def enriched_context(spark, sf):
    df = _extracted(spark, sf)
    return df.select("item_id", I.enriched_context(df).alias("item_context"))


_MERGED = f"(select item_id, title, description_text, case when p_partkey % 50 = 0 then null else features_text end as features_text, {_ENRICHED} as item_context from {_FULL} where p_partkey % 200 <> 7)"


@query(" union all ".join([_kept("merged", _MERGED, 0.99), _there("merged", ("title", "description_text", "features_text", "item_context"), ())] + [_gate(n, v, a, b, False).format(t="merged", f=_MERGED) for n, v, a, b in (("surplus_keys", "count(*) - count(distinct item_id)", 1, 1), *((f"null_{c}", f"avg(({c} is null)::int)", 0.001, 0.02) for c in ("title", "description_text", "features_text")), ("empty_contexts", "count(*) filter (length(item_context) = 0)", 1, 1), ("short_contexts", "count(*) filter (length(item_context) < 100)", 1, _INF))] + [_gate("sequence_items", "count(k) / count(*)::double", 0.99, 0.95).format(t="merged", f=f"(select distinct item_id from numbered) left join (select distinct item_id, 1 as k from {_MERGED}) using (item_id)")]))
def merged_report(spark, sf):
    df = _extracted(spark, sf).where("p_partkey % 200 <> 7")
    df = df.withColumn("item_context", I.enriched_context(df)).withColumn("features_text", F.expr("case when p_partkey % 50 <> 0 then features_text end"))
    return quality.merged_report(df.select("item_id", "title", "description_text", "features_text", "item_context"), items(spark, sf), user_sequences(spark, sf))


@query("select p_partkey, coalesce(case when p_partkey % 3 <> 0 then features_text end, case when p_partkey % 6 <> 0 then store end) as features_text, try_cast(case when p_partkey % 4 = 0 then '12' when p_partkey % 4 = 1 then '4.5x' when p_partkey % 4 = 2 then '' end as int) as number from items")
def fallbacks(spark, sf):
    k = F.col("p_partkey")
    df = items(spark, sf).select("p_partkey", F.when(k % 3 != 0, F.col("features_text")).alias("features_text"), F.when(k % 6 != 0, F.col("store")).alias("original_features_text"), F.when(k % 4 == 0, "12").when(k % 4 == 1, "4.5x").when(k % 4 == 2, "").alias("raw"))
    return I.features_or_original(df).select("p_partkey", "features_text", I.lenient(F.col("raw"), "int").alias("number"))


@query("select event_type, user_id, avg(x)::double as a, avg(y)::double as b from (select event_type, user_id, case when event_id % 2 = 0 then m end as x, case when event_id % 2 = 1 then m end as y from (select event_type, user_id, event_id, max(event_id) over (partition by event_type, user_id, event_id % 2) as m from events)) group by all having a is not null and b is not null", views=False)
def paired_arms(spark, sf):
    e = table(spark, sf, "events")
    arms = [e.where(F.col("event_id") % 2 == k).groupBy("event_type", "user_id").agg(F.max("event_id").cast("double").alias("v")) for k in (0, 1)]
    return statistics.paired_arms(*arms, "event_type", "user_id", "v")


@query("select p_partkey, list_transform(range(1, 11), lambda i: case when i between 4 and 6 then i when i between 9 and 10 and p_partkey % 2 = 0 then i else -100 end)::int[] as labels from part", views=False)
def label_masks(spark, sf):
    # a template 2, 3 at the second place, an end 6, and for even keys a second template at the seventh
    ids = F.expr("transform(sequence(1, 10), i -> case when i = 7 and p_partkey % 2 = 0 then 2 when i = 8 and p_partkey % 2 = 0 then 3 else i end)")
    rows = table(spark, sf, "part").select("p_partkey", ids.alias("ids"))
    return rows.select("p_partkey", statistics.masked(F.col("ids"), [2, 3], 6).alias("labels"))
