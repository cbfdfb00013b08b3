"""Queries of the corpus operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtide.llm import audit, collocations, decontam, lines, mixing, neardup, pages, pieces, quality, secrets, sharding, toxicity, warc
from loomtide.session import shared_folder
from registry.common import Registry, table

REG = Registry()

# A-Z to lower case, and the two kinds of words, in SQL
LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"


OP1_SQL = """
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
           ('0x' || substr(md5(concat('mix20|', doc_id)), 1, 15))::bigint as k
    from documents
),
s as (
    select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w
    from d group by source
),
o as (select *, row_number() over (order by source_size::double / w, source nulls last) as i from s),
c as (
    select *, sum(source_size) over () as total, sum(w) over () as parts,
           coalesce(sum(3 * source_size) over front, 0) as size_before, coalesce(sum(w) over front, 0) as w_before
    from o window front as (order by i rows between unbounded preceding and 1 preceding)
),
f as (
    select *, bool_and((total - size_before) * w > 3 * source_size * (parts - w_before)) over (order by i) as is_full from c
),
r as (
    select *, (total - coalesce(sum(3 * source_size) filter (is_full) over (), 0))::bigint as rest,
           (parts - coalesce(sum(w) filter (is_full) over (), 0))::bigint as rest_parts
    from f
),
t as (
    select source, source_size, case when is_full then 3.0 * source_size else (rest * w)::double / rest_parts end::double as target,
           case when is_full then 3 * source_size else (rest * w) // rest_parts end as words
    from r
),
b as (select *, sum(size) over (partition by source order by k, doc_id) - size as before from d)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else (words // source_size) * size + greatest(0, least(size, words % source_size - before)) end::bigint as taken
from b join t on b.source is not distinct from t.source
"""


@REG.add("op1_mix_tree", OP1_SQL)
def op1(spark, folder):
    found = mixing.mix(table(spark, folder, "documents"), columns=["doc_id"])
    plan = spark.createDataFrame(
        [(s.key, s.size, float(s.target)) for s in found.sources], "_g string, source_size long, target double"
    )
    return found.taken().join(F.broadcast(plan), "_g", "left").select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@REG.add("op2_site_style_tree")
def op2(spark, folder):
    text = F.col("main_text")
    return pages.extract(table(spark, folder, "pages")).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")
    )


@REG.add("op6_interleaved_shards")
def op6(spark, folder):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.interleave(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@REG.add("op3_repetition_quality")
def op3(spark, folder):
    q = F.col("quality")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.repetition(docs).select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), F.concat_ws(",", q["failed"]).alias("failed"),
    )


@REG.add("op4_line_dedup", """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
),
common as (
    select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
),
marked as (
    select k.*, c.key is not null and k.doc_id <> c.last as gone from keyed k left join common c using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


OP5_SQL = f"""
with d as (select doc_id, {ALNUM_WORDS.format('text')} as w from documents),
items as (select item_id, w, least(10, len(w)) as n from (select item_id, {ALNUM_WORDS.format('text')} as w from benchmark) where len(w) > 0),
windows as (
    select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
    from (select *, unnest(range(1, len(w) - n + 2)) as i from items)
),
found as (
    select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from items))
),
hits as (select doc_id, i, n, item_id from found join windows using (n, k)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
named as (
    select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
    from hits group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""


@REG.add("op5_suffix_decontamination", OP5_SQL)
def op5(spark, folder):
    found = F.col("contamination")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hit = decontam.n_hit(found["spans"])
    return decontam.find_matches(docs, table(spark, folder, "benchmark")).select(
        "doc_id", found["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@REG.add("op7_warc_captures", """
with pages_ as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
hashed as (select page_id, payload_bytes, sha256(html) as payload_digest from pages_),
first as (select payload_digest, min(page_id) as page_id from hashed where payload_bytes >= 100 group by 1)
select h.page_id, h.payload_bytes, h.payload_digest,
       case when f.page_id <> h.page_id then 'revisit' else 'response' end as record_type,
       (case when f.page_id <> h.page_id then f.page_id end)::double as refers_to
from hashed h left join first f using (payload_digest)
""")
def op7(spark, folder):
    archive = shared_folder(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), archive)
    return warc.page_captures(warc.assemble(warc.read_warc(spark, archive)))


OP8_SQL = f"""
with recursive d as (select doc_id, {WORDS.format('text')} as w from documents),
shingles as (
    select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
    from (select *, unnest(range(1, greatest(len(w), 2))) as i from d where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
links as (
    select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
),
edges as (select x, y from links union all select y, x from links),
reached as (select doc_id, doc_id as other from documents union select r.doc_id, y from reached r join edges on x = other)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept
from reached r left join sizes using (doc_id) group by r.doc_id
"""


@REG.add("op8_odd_sketch_near_duplicates", OP8_SQL)
def op8(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), shingle=2)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@REG.add("op9_ftrl_toxicity")
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted"
    )


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@REG.add("op10_secret_entropy")
def op10(spark, folder):
    found = F.col("secrets")
    base = F.filter(found, lambda s: s["kind"] != "entropy")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.scan(docs).select(
        "doc_id",
        *[_count(found, kind).alias(f"n_{kind}") for kind in secrets.KINDS if kind != "entropy"],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(found).alias("spans"),
        _count(found, "entropy").alias("n_entropy"),
    )


OP12_SQL = """
with recursive d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
    from documents
),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
firsts as (select t, min(doc_id) as lowest from d group by 1),
masks as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
           (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
           + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
           + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > lowest, false)::int as mask
    from d join firsts using (t) left join said using (doc_id)
),
cells as (select part, mask, count(*) as n, sum(good)::bigint as good, sum(toxic)::bigint as toxic from masks group by 1, 2),
grown as (
    select '' as p, 0 as step, 0 as applied, 0 as bit
    union all
    select p || c, step + 1, applied | bit, 1 << (instr('ABCDE', c)::int - 1)
    from grown, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) where instr(p, c) = 0
),
steps as (
    select part, p, step, bit,
           coalesce(sum(n) filter (mask & (applied | bit) = 0), 0)::bigint as kept,
           coalesce(sum(n) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint as removed,
           coalesce(sum(n) filter (mask & bit <> 0 and mask & applied <> 0), 0)::bigint as redundant,
           coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
           coalesce(sum(good) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint as good_lost,
           coalesce(sum(toxic) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint as toxic_lost
    from grown, cells where step > 0 group by part, p, step, bit
),
orders as (select p as filter_order from grown where step = 5)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from orders join steps on starts_with(filter_order, p)
"""


@REG.add("op12_filter_orders", OP12_SQL)
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return audit.audit(audit.mask_cells(docs, table(spark, folder, "labels").select("doc_id", "quality", "toxic")))


OP11_SQL = f"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWERED.format('text')}, '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from w group by 1 having sum(len(w)) > 0),
grams as (
    select lang, n as words, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase
    from (select lang, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select unnest([1, 2, 3, 4]) as n) where len(w) >= n)
),
f as (select lang, words, phrase, count(*) as a from grams group by 1, 2, 3 having count(*) >= 30),
split as (select *, string_split(phrase, ' ') as p from f where words > 1),
cuts as (
    select lang, phrase, a, k, array_to_string(p[1:k], ' ') as front, array_to_string(p[k + 1:], ' ') as rest
    from (select *, unnest(range(1, words)) as k from split)
),
scored as (
    select c.lang, c.phrase, c.a, x.a as l, y.a as r, (2000000::hugeint * c.a // (x.a + y.a))::bigint as score
    from cuts c join f x on x.lang = c.lang and x.phrase = front join f y on y.lang = c.lang and y.phrase = rest
    qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1
),
held as (
    select lang, array_to_string(p[i:i + m - 1], ' ') as phrase, max(a) as most
    from (
        select *, unnest(range(1, words - m + 2)) as i
        from (select *, unnest(range(2, words)) as m from split where words > 2)
    ) group by 1, 2
),
ranked as (
    select s.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from scored s left join held using (lang, phrase) where most is null or 100::hugeint * most < 80::hugeint * a
)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""


@REG.add("op11_phrase_collocations", OP11_SQL)
def op11(spark, folder):
    return collocations.collocations(table(spark, folder, "documents").select("doc_id", "lang", "text"))


@REG.add("op13_marked_words")
def op13(spark, folder):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return pieces.encode(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(pieces.decode(F.col("ids"), model).cast("binary"), 256).alias("decoded_sha256"),
    )
