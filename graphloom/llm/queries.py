"""One query per operator, with production parameters over whole tables, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, collocations, decontaminate, exact_topk, fm_dedup, hard_negatives, html_extract, license_scan, quality_model, quality_rules, sa_dedup, simhash_dedup, sp_codec
from graphloom.session import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], given.schema)
    turns = given.union(added).withColumn("parts", chat_format.text_parts())
    return chat_format.conversation_digests(chat_format.format_turns(turns))


def op3_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.removal_report(table(spark, sf_dir, "documents"))


def op4_sa_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa_dedup.removal_report(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash_dedup.hex_digits(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.segmentations(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality_rules.SHARES)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_chat_format, op3_fm_dedup, op4_sa_dedup, op5_simhash_dedup, op6_sentencepiece, op7_quality_model, op8_quality_rules, op9_license_scan, op10_decontaminate, op11_hard_negatives, op12_collocations, op13_exact_topk)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _quality_sql() -> str:
    gone = lambda kind: f"(length(t)-length(regexp_replace(t, '[{kind}]', '', 'g')))"

    def bound(part: str, of: str) -> str:
        n = f"greatest({of}, 1)::DOUBLE"
        p = f"least(1.0::DOUBLE, ({part})/{n})"
        return f"floor(1000*greatest(0.0::DOUBLE, ({p}+4.5::DOUBLE/{n}-3*sqrt({p}*(1-{p})/{n}+2.25::DOUBLE/({n}*{n})))/(1+9/{n}))+1e-9::DOUBLE)::INT"

    bin_of = lambda part, of: f"floor({quality_rules.DOUBLING}*log2((({part})+0.5)/(({of})+1))+1e-9)::INT"
    counts = zip(quality_rules.SHARES, (("n_symbols", "word_chars"), ("up", "word_chars"), ("sh", "word_chars"), ("e", "n_words")), strict=True)
    bins = " UNION ALL ".join(f"SELECT lang, source, '{s}' share, {bin_of(*of)} bin FROM m WHERE NOT base_failed" for s, of in counts)
    at = lambda q: f"list_sort(list(bin))[({q}*count(*)+9)//10]"
    levels = f"count(*) n, {at(quality_rules.LOW)} low, {at(quality_rules.HIGH)} high"
    drawn = lambda own, n, other: f"(({n}*{own}+{quality_rules.PRIOR}*{other})/({n}+{quality_rules.PRIOR}))"
    level = lambda q: drawn(f"o.{q}", "o.n", drawn(f"l.{q}", "l.n", f"a.{q}"))
    tests = " AND ".join(f"{s} <= coalesce((SELECT fence FROM fences f WHERE f.share='{s}' AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source), 1000)" for s in quality_rules.SHARES)
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l FROM documents),
 win AS (SELECT doc_id, s, md5(array_to_string(w[s:s+7], ' ')) g FROM d, unnest(range(1, len(w)-6)) t(s)),
 rep AS (SELECT doc_id, count(DISTINCT i) n FROM (SELECT doc_id, unnest(range(s, s+8)) i FROM win SEMI JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY 1),
 ech AS (SELECT doc_id, count(*) n FROM d, unnest(range(1, len(w))) t(i) WHERE w[i]=w[i+1] GROUP BY 1),
 c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT n_words, (length(t)-{gone("\\x20\\x09-\\x0D")})::BIGINT word_chars, {gone("#*$%&|<>")}::BIGINT n_symbols, (len(l)-len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words, {gone("A-Z")} up, {gone("!?")} sh, coalesce(ech.n, 0) e FROM d LEFT JOIN rep ON d.doc_id=rep.doc_id LEFT JOIN ech ON d.doc_id=ech.doc_id),
 m AS (SELECT *, n_words < 20 OR 100*n_repeat_words > 30*n_words base_failed, {bound("n_symbols", "word_chars")} symbol_share, {bound("up", "word_chars")} upper_share, {bound("sh", "word_chars")} shout_share, {bound("e", "n_words")} echo_share FROM c),
 h AS ({bins}), own AS (SELECT lang, source, share, {levels} FROM h GROUP BY ALL), lng AS (SELECT lang, share, {levels} FROM h GROUP BY ALL), whole AS (SELECT share, {levels} FROM h GROUP BY ALL),
 fences AS (SELECT o.lang, o.source, o.share, least(1000, ceil(1000*pow(2.0::DOUBLE, ({level("high")}+{quality_rules.FENCE}*greatest({level("high")}-{level("low")}, {quality_rules.DOUBLING}.0::DOUBLE))/{quality_rules.DOUBLING})-1e-9::DOUBLE)) fence FROM own o JOIN lng l ON o.share=l.share AND o.lang IS NOT DISTINCT FROM l.lang JOIN whole a ON o.share=a.share)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} kept, {", ".join(quality_rules.SHARES)} FROM m"""


def _integers(scale: int, more: str = "") -> str:
    """Vectors that take part, as whole numbers."""
    return f"SELECT vec_id{more}, list_transform(embedding, lambda x: floor({scale}*x::DOUBLE)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0"


_PHRASE = "array_to_string(w[{}:{}], ' ')"

ORACLE_SQL = {
    "op11_hard_negatives": f"""WITH v AS ({_integers(256, ", CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END label")} AND label IS NOT NULL),
 s AS (SELECT a.vec_id anchor_id, c.vec_id, a.label = c.label same, list_dot_product(a.e, c.e)::BIGINT score FROM v a JOIN v c ON a.vec_id%100=0 AND a.vec_id <> c.vec_id),
 p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, (row_number() OVER w)::INT rank, vec_id negative_id, positive_score, score negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 100*score BETWEEN 30*positive_score AND 90*positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op12_collocations": f"""WITH p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w FROM (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents)),
 f AS (SELECT lang, k, {_PHRASE.format("i", "i+k-1")} phrase, count(*) f FROM p, range(1, 6) a(k), unnest(range(1, len(w)-k+2)) b(i) GROUP BY ALL HAVING count(*) >= 100),
 n AS (SELECT lang, sum(len(w))::BIGINT n FROM p GROUP BY 1), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') w, f a FROM f WHERE k > 1),
 cut AS (SELECT c.lang, c.k, phrase, a, j, {_PHRASE.format("1", "j")} x, {_PHRASE.format("j+1", "k")} y FROM c, unnest(range(1, k)) t(j)),
 s AS (SELECT cut.lang, cut.phrase, a, j, l.f l, r.f r, n, ((1000::HUGEINT*a*n)//(l.f::HUGEINT*r.f))::BIGINT score FROM cut JOIN f l ON l.lang=cut.lang AND l.phrase=x JOIN f r ON r.lang=cut.lang AND r.phrase=y JOIN n ON n.lang=cut.lang QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1),
 held AS (SELECT lang, {_PHRASE.format("i", "i+m-1")} phrase, max(a) longer FROM c, unnest(range(2, k)) t(m), unnest(range(1, k-m+2)) u(i) GROUP BY ALL)
 SELECT s.lang, row_number() OVER w rank, s.phrase, a, l, r, n, score FROM s LEFT JOIN held h ON h.lang=s.lang AND h.phrase=s.phrase WHERE longer IS NULL OR longer < a WINDOW w AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) QUALIFY rank <= 2000""",
    "op13_exact_topk": f"""WITH v AS ({_integers(64)}) SELECT q.vec_id query_id, (row_number() OVER w)::INT rank, c.vec_id, list_dot_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON q.vec_id%20=0 AND c.vec_id <> q.vec_id
 WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 20""",
    "op3_fm_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
 win AS (SELECT doc_id, s, md5(array_to_string(w[s:s+34], ' ')) g FROM d, unnest(range(1, len(w)-33)) t(s)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s, s+35)) i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
 word AS (SELECT doc_id, i, w[i] x FROM d, unnest(range(1, len(w)+1)) t(i)),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) text, count(*) n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT n_words, (len(w)-coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(text, '')) kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op8_quality_rules": _quality_sql(),
    "op10_decontaminate": f"""WITH d AS (SELECT doc_id, {_TOKENS} w FROM documents), i AS (SELECT item_id, {_TOKENS} w FROM benchmark),
 item AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[s:s+least(len(w), 10)-1], ' ') g FROM i, unnest(range(1, len(w)-least(len(w), 10)+2)) t(s) WHERE len(w) > 0),
 doc AS (SELECT doc_id, s, k, array_to_string(w[s:s+k-1], ' ') g FROM d, (SELECT DISTINCT k FROM item), unnest(range(1, len(w)-k+2)) t(s)),
 hit AS (SELECT doc_id, s, k, item_id FROM doc JOIN item USING (k, g)),
 place AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(s, s+k)) p FROM hit) GROUP BY 1),
 ids AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM hit) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(place.n, 0)::BIGINT n_hit, coalesce(ids.n, 0)::BIGINT n_items, sha256(coalesce(x, '')) items_sha256, coalesce(place.n, 0) > 0 contaminated
 FROM d LEFT JOIN place ON d.doc_id = place.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id""",
}
