"""The registered queries of this subpackage: thin digests of the operators' results.

Those whose result SQL can express have oracle SQL, by the plainest way to say it;
the others rest on a trained model, a tokenizer or an approximate search and are
tested against brute force in ``tests/llm``, as are all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, jaccard, langid, neighbours, packing, perplexity, pieces, repair, substrings, warc, weaklabels
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.quality_scores(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(table(spark, sf_dir, "documents"), n=4)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents")).drop("row")


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts before its model judges."""
    return perplexity.count_rules(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, k=10)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), k=5, percent=75)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(added)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), least=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000, share=80)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    found = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), F.col("live"))
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(said, "\n"), 256)).drop("repaired")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_language_id,
        op3_sentencepiece,
        op4_quality_rules,
        quality_base_rules,
        op5_nearest_neighbours,
        op6_jaccard_join,
        op7_warc,
        op8_chat_formatting,
        op9_substring_dedup,
        op10_packing,
        op11_decontamination,
        op12_collocations,
        op13_conversation_repair,
    )
}

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _repair_sql() -> str:
    """The repair as a forward programme: the least (cost, edit string) of each state, a row a turn, both in one string that sorts by cost."""

    def add(state: str, cost: str, letter: str) -> str:
        return f"printf('%09d', cast(left({state}, 9) as bigint) + {cost}) || substr({state}, 10) || '{letter}'"

    def step(letter: str, cost: str) -> dict[str, str]:
        return {"v2": ", ".join(add(v, cost, letter) for v in ("v0", "v1", "v3")), "v3": add("v2", cost, letter)}

    kept, rerole, put = step("K", "more"), step("R", "3 + more"), step("I", "3")
    gone = {v: add(v, "4", "D") for v in ("v0", "v1", "v2", "v3")}
    inserted = f"select conv_id, t, v0, v1, v2, least(v3, {put['v3']}) as v3 from (select conv_id, t, v0, v1, least(v2, {put['v2']}) as v2, v3 from {{}})"
    return rf"""with recursive table_ as (select list(x order by i) as crc from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as x from range(256) as r(i))),
 keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
 fated as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: cast(ascii(k[i]) as bigint))), lambda x, b: xor(crc[xor(x & 255, b) + 1], x >> 8)), 4294967295) % 20 as fate from keyed, table_),
 damaged as (select conv_id, turn, case fate when 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) as copy from fated),
 placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as t, left(role, 1) as kind, not regexp_matches(text, '[^ 	-
]') as blank, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as last from damaged),
 pairs as (select *, row_number() over (partition by conv_id, role, text order by t) > 1 as again, lag(kind) over (partition by conv_id order by t) || kind as pair from placed),
 faults as (select *, blank or again as gone, case when not blank and not again and last not in ('.', '!', '?') then 3 else 0 end as more from pairs),
 told as (select conv_id, count(turn) as turns, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, count(*) filter (where more > 0) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, max(t) as n from faults group by conv_id),
 states as (select distinct conv_id, cast(0 as bigint) as t, '000000000' as v0, cast(null as varchar) as v1, cast(null as varchar) as v2, cast(null as varchar) as v3 from conversations union all
  select s.conv_id, s.t + 1, {gone['v0']}, case when gone or kind <> 's' then {gone['v1']} else least({gone['v1']}, {add('v0', 'more', 'K')}) end,
  case when gone then {gone['v2']} when kind = 'u' then least({gone['v2']}, {kept['v2']}, {rerole['v2']}) else least({gone['v2']}, {rerole['v2']}) end,
  case when gone then {gone['v3']} when kind = 'a' then least({gone['v3']}, {kept['v3']}, {rerole['v3']}) else least({gone['v3']}, {rerole['v3']}) end
  from ({inserted.format('states')}) s join faults f on f.conv_id is not distinct from s.conv_id and f.t = s.t + 1),
 ended as (select s.conv_id, least(v0, v3) as best from ({inserted.format('states')}) s left join told n on n.conv_id is not distinct from s.conv_id where s.t = coalesce(n.n, 0)),
 edits as (select conv_id, p, substr(best, p + 9, 1) as edit from (select conv_id, best, unnest(range(1, length(best) - 8)) as p from ended)),
 rows_ as (select *, count(*) filter (where edit <> 'I') over (partition by conv_id order by p) as t, count(*) filter (where edit <> 'D') over (partition by conv_id order by p) as j from edits),
 outs as (select r.conv_id, r.p, r.j, r.edit, f.role, case when edit = 'I' then '' else f.text end as text, bool_or(edit = 'K' and kind = 's') over (partition by r.conv_id) as led from rows_ r left join faults f on f.conv_id is not distinct from r.conv_id and f.t = r.t and edit <> 'I' where edit <> 'D'),
 said as (select conv_id, string_agg(case when edit = 'K' then role when (j % 2 = 1) = led then 'assistant' else 'user' end || ':' || text, chr(10) order by p) as body from outs group by conv_id)
 select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(left(best, 9) as bigint) as cost, substr(best, 10) as audit, sha256(coalesce(body, '')) as repaired_sha256
 from ended e left join told t on t.conv_id is not distinct from e.conv_id left join said s on s.conv_id is not distinct from e.conv_id"""


ORACLES: dict[str, str] = {
    "op11_decontamination": rf"""with b as (select item_id, {_TOKENS} as x from benchmark), d as (select row_number() over () as r, doc_id, {_TOKENS} as x from documents),
 i as (select distinct item_id, least(len(x), 10) as k, array_to_string(x[p : p + least(len(x), 10) - 1], ' ') as w from (select item_id, x, unnest(range(1, len(x) - least(len(x), 10) + 2)) as p from b where len(x) > 0)),
 s as (select r, k, p, array_to_string(x[p : p + k - 1], ' ') as w from (select r, x, k, unnest(range(1, len(x) - k + 2)) as p from d, (select distinct k from i) where len(x) >= k)),
 h as (select r, item_id, s.k, p from s join i on i.k = s.k and i.w = s.w),
 c as (select r, count(distinct p) as n from (select r, p + unnest(range(k)) as p from (select distinct r, k, p from h)) group by r),
 n as (select r, count(*) as n, string_agg(item, ',' order by item) as t from (select distinct r, cast(item_id as varchar) as item from h where item_id is not null) group by r)
 select doc_id, len(x) as n_words, coalesce(c.n, 0) as n_hit, coalesce(n.n, 0) as n_items, sha256(coalesce(n.t, '')) as items_sha256, c.n is not null as contaminated from d left join c on c.r = d.r left join n on n.r = d.r""",
    "op12_collocations": rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as x from p), n as (select lang, cast(sum(len(x)) as bigint) as n from w group by lang),
 g as (select lang, k, array_to_string(x[i : i + k - 1], ' ') as phrase from (select lang, x, k, unnest(range(1, len(x) - k + 2)) as i from w, range(1, 5) as s(k) where len(x) >= k)),
 f as (select lang, k, phrase, count(*) as a, string_split(phrase, ' ') as x from g group by all having count(*) >= 30),
 c as (select f.lang, f.phrase, f.a, f.k as size, cut, l.a as l, r.a as r, cast(cast(2000000 as hugeint) * f.a // (cast(l.a as hugeint) + r.a) as bigint) as score from (select *, unnest(range(1, k)) as cut from f) f
  join f l on l.lang = f.lang and l.phrase = array_to_string(f.x[1:cut], ' ') join f r on r.lang = f.lang and r.phrase = array_to_string(f.x[cut + 1 :], ' ')),
 b as (select * from c qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 i as (select lang, array_to_string(x[p : p + m - 1], ' ') as phrase, max(a) as longer from (select lang, a, x, k, m, unnest(range(1, k - m + 2)) as p from (select lang, a, x, k, unnest(range(2, k)) as m from f where k > 2)) group by 1, 2),
 o as (select b.* from b left join i on i.lang = b.lang and i.phrase = b.phrase where i.longer is null or 100 * i.longer < 80 * b.a)
 select o.lang, row_number() over (partition by o.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang qualify rank <= 2000""",
    "op13_conversation_repair": _repair_sql(),
    "op6_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as x from documents),
 s as (select distinct doc_id, case when len(x) < 5 then md5(array_to_string(x, ' ')) else md5(array_to_string(x[i : i + 4], ' ')) end as k
  from (select doc_id, x, unnest(range(1, greatest(len(x) - 4, 1) + 1)) as i from w where len(x) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 i as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
 l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.n >= 75 * (x.n + y.n - i.n)),
 e as (select a, b from l union all select b, a from l),
 r as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on e.a = r.other)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, m.least as component_id from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(other) as least from r group by doc_id) m on m.doc_id = d.doc_id""",
    "quality_base_rules": f"""with w as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS.format(text="text")} as x from documents),
 v as (select r, i, array_to_string(x[i : i + 2], ' ') as k from (select r, x, unnest(range(1, len(x) - 1)) as i from w where len(x) >= 3)),
 g as (select distinct r, i + j as p from (select r, i, count(*) over (partition by r, k) as c from v) cross join range(3) as q(j) where c > 1),
 n as (select r, count(*) as n from g group by r),
 l as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
 c as (select doc_id, len(x) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(n.n, 0) as n_repeat_words
  from w left join l on l.r = w.r left join n on n.r = w.r)
 select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c""",
    "op7_warc": """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
 m as (select *, max(page_id) over (partition by payload_digest) as last from p)
 select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 1000 and last <> page_id then last end as refers_to from m""",
    "op8_chat_formatting": r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 c as (select *, case role when 'user' then ' [/INST]' when 'assistant' then ' </s>' when 'system' then ' <</SYS>>' else ' [/ROLE]' end as stop,
  case role when 'user' then 18 when 'assistant' then 14 when 'system' then 20 else 19 + length(role) end as marks from t),
 f as (select *, length(text) + marks + case when contains(text, stop) or regexp_matches(text, '[<\[]\\+(/?s>|/?INST\]|OUT\]|</?SYS>>|/?ROLE\b)') then len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|OUT\]|</?SYS>>|/?ROLE\b)')) else 0 end as chars from c)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id""",
    "op9_substring_dedup": f"""with w as (select doc_id, {_WORDS.format(text="text")} as x from documents),
 v as (select doc_id, i, md5(array_to_string(x[i : i + 34], ' ')) as k from (select doc_id, x, unnest(range(1, len(x) - 33)) as i from w where len(x) >= 35)),
 g as (select distinct doc_id, i + j as p from v semi join (select k from v group by k having count(*) > 1) d on d.k = v.k cross join range(35) as q(j)),
 p as (select doc_id, unnest(x) as word, unnest(range(1, len(x) + 1)) as p from w),
 k as (select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.p) as t from p anti join g on g.doc_id = p.doc_id and g.p = p.p group by p.doc_id)
 select w.doc_id, len(x) as n_words, len(x) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id""",
}
