"""Queries that apply each operator, with production parameters, to its whole table, and SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespool.llm import (
    contextpii, crossparse, curvepack, gnat, knnquality, latentleaks, licenses, merkle, randomtests, repetition, replytrees, simhash, urltrie)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


EOS = 2


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_curve_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = curvepack.pack(read(spark, sf_dir, "documents"), tokenizer_path(), EOS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_cross_parsing")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.identify(read(spark, sf_dir, "documents"))


@query("op4_simhash_bktree")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.group(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _url_sql() -> str:
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
            for _, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))]
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))
    rule = " ".join(f"{f} then '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = " ".join(f"{f} then '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    return f"""with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
        parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut)
        select page_id, host, path, case {rule} end as rule, case {verdict} else 'allow' end as verdict from parts"""


@query("op5_url_trie", _url_sql())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrie.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query("op6_contextual_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextpii.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op7_repetition_coverage")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(read(spark, sf_dir, "documents"))


@query("op8_latent_leaks")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latentleaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_knn_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knnquality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


CHAT_SQL = """with rows as (
        select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
        union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    escaped as (select *, replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '[', '\\b') r,
                       replace(replace(replace(text, '\\', '\\\\'), '<', '\\l'), '[', '\\b') t from rows)
    select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
           coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
           sum(length(replace(r, '|', '\\p')) + length(t) + 8)::bigint formatted_chars
    from escaped group by conv_id"""


@query("op10_reply_trees", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree of one branch: a row's parent is the row before it.  Rows without an id are one conversation."""
    own = spark.sql("""select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
                       (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    nodes = replytrees.chain(rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "key", "turn")
    chats = replytrees.read_back(replytrees.format_trees(nodes))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.nullif("tree", F.lit("")).cast("long").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::varchar)::varchar || ':' || ({column})::varchar, '-')"


def _leaf(**other: str) -> str:
    return f"sha256({' || '.join(_field(other.get(c, c)) for c in merkle.FIELDS)})"


MANIFEST_SQL = f"""with recursive
    leaves as (select doc_id, coalesce('=' || lang, '') grp, {_leaf()} h, {_leaf(n_chars='n_chars + 1')} changed,
        n_chars is not null and xor(4294967295, list_reduce(
            [4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))
        )) % 7 = 0 tampered from documents),
    placed as (select *, row_number() over (partition by grp order by doc_id nulls first, h) - 1 pos, count(*) over (partition by grp) n from leaves),
    lower as (select grp, 0 lvl, pos, n, h from placed
        union all select grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from lower where n > 1 group by all),
    tops as (select grp, h, max(lvl) over () lvl, row_number() over (order by encode(grp)) - 1 pos, count(*) over () n from lower where n = 1),
    upper as (select 0 lvl, pos, n, h from tops
        union all select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from upper where n > 1 group by all),
    steps as (
        select p.grp, p.pos, s.lvl, s.h, s.pos & 1 behind from placed p join lower s on s.grp = p.grp and s.pos = xor(p.pos >> s.lvl, 1)
        union all
        select p.grp, p.pos, 1000 + s.lvl, s.h, s.pos & 1 from placed p join tops t on t.grp = p.grp join upper s on s.pos = xor(t.pos >> s.lvl, 1)),
    levels as (
        select p.grp, p.pos, l.lvl from placed p join (select distinct grp, lvl from lower where n > 1) l using (grp)
        union all select p.grp, p.pos, 1000 + l.lvl from placed p, (select distinct lvl from upper where n > 1) l),
    path as (select l.grp, l.pos, list({{'h': coalesce(s.h, ''), 'behind': coalesce(s.behind, 1)}} order by l.lvl) path
        from levels l left join steps s using (grp, pos, lvl) group by all),
    folded as (select p.*, coalesce(list_transform(path, lambda s: s.h), []) siblings, 0 k, case when tampered then changed else h end f, path
        from placed p left join path using (grp, pos)
        union all select * replace (k + 1 as k, case when path[k + 1].behind = 1 then sha256(f || path[k + 1].h) else sha256(path[k + 1].h || f) end as f)
        from folded where k < len(siblings))
    select doc_id, f.h leaf, t.h subroot, r.h root, sha256(array_to_string(siblings, '')) proof_sha256, f.f folded_root, f.f = r.h verified
    from folded f join tops t using (grp), (select h from upper where n = 1) r where f.k = len(siblings)"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    nearest = """select r, p, min({{'d': list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) best
        from pieces q join book{0} c using (p) group by r, p"""
    ctes = [f"""kept as materialized (select row_number() over (order by vec_id) r, vec_id, label,
            list_transform(embedding, lambda x: floor({gnat.SCALE} * x::double)::bigint) v from embeddings
            where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
            f"""pieces as materialized (select r, p, v[p * (len(v) // {gnat.PARTS}) + 1:(p + 1) * (len(v) // {gnat.PARTS})] v
            from kept, range({gnat.PARTS}) t(p))""",
            f"book0 as materialized (select p, r - 1 e, v from pieces where r <= {gnat.ENTRIES})"]
    for k in range(gnat.ROUNDS):
        ctes += [f"near{k} as materialized ({nearest.format(k)})",
                 f"""mean{k} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) v from (
            select p, best.e e, i, sum(v[i])::hugeint s, count(*) n
            from (select p, best, v, unnest(range(1, len(v) + 1)) i from near{k} join pieces using (r, p)) group by all) group by all)""",
                 f"book{k + 1} as materialized (select p, e, coalesce(m.v, b.v) v from book{k} b left join mean{k} m using (p, e))"]
    return f"""with {", ".join(ctes)}, final as ({nearest.format(gnat.ROUNDS)}),
        coded as (select vec_id, label, string_agg(format('{{:02x}}', best.e), '' order by p) code, sum(best.d)::bigint error
            from final join kept using (r) group by r, vec_id, label)
        select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
            (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book{gnat.ROUNDS}) codebooks_sha256 from coded"""


@query("op13_gnat_codes", _codes_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.report(read(spark, sf_dir, "embeddings"))


@query("op11_randomness_battery")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = randomtests.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(randomtests.listed("base"), 256).alias("base_sha256"),
                        randomtests.listed("spans").alias("spans"))
