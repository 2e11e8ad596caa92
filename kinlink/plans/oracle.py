"""DuckDB SQL that gives the same rows as the queries of the registry.

Statements are put together from common table expressions; rules come from the same fixed values as the Spark functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from types import ModuleType

from kinlink.functions import vocabulary as V
from kinlink.operators import decision

_FROM, _TO = V.folded()
_FROM2, _TO2 = V.folded(0x24F)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words: Iterable[str]) -> str:
    return "(" + ", ".join(_q(w) for w in sorted(words)) + ")"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


def clean(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    for a, b in V.SPELLED.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    x = f"translate(translate({x}, {_q(_FROM)}, {_q(_TO)}), {_q(V.VANISHING)}, '')"
    return f"trim({_sub(x, r'[^a-z0-9\x{2FFF}\x{3001}-\x{10FFFF}]+', ' ')})"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def mapped(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {_q(word)} THEN {_q(form)}" for word, form in table.items())
    return f"list_filter(list_transform({x}, lambda w: CASE w {cases} ELSE w END), lambda w: w <> '')"


def joined(x: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({x}, {_q(sep)}), '')"


def phrased(x: str) -> str:
    for phrase, form in V.LEGAL_PHRASES:
        x = _sub(x, phrase + r"\s+", form)
    return x


def name_norm(x: str) -> str:
    return joined(mapped(words(phrased(clean(x))), V.LEGAL_FORMS))


def without(x: str, drop: set[str]) -> str:
    return f"list_filter({x}, lambda w: w NOT IN {_in(drop)})"


def addr_norm(x: str) -> str:
    return joined(mapped(words(clean(x)), V.ADDRESS_FORMS))


def trigrams(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) <= 3 THEN [{x}] ELSE list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) END"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both}) END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"


def _number(x: str) -> str:
    """Order of targets: source prefix, number, id."""
    return f"substr({x}, 1, 2), coalesce(TRY_CAST(regexp_extract({x}, '([0-9]+)$', 1) AS BIGINT), -1), {x}"


#: Offset basis and prime of the 64-bit FNV-1a hash (fixed values).
OFFSET, PRIME = 14695981039346656037, 1099511628211

FUZZ = ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")

#: Soundex digits of a to z (fixed values): 0 parts equal neighbours, 7 does not.
SOUNDEX = "01230127022455012623017202"


def soundex(w: str) -> str:
    digits = lambda x: f"translate(translate({x}, '0123456789', '0000000000'), 'abcdefghijklmnopqrstuvwxyz', '{SOUNDEX}')"
    code = f"{digits(f'substr({w}, 1, 1)')} || {digits(f"translate(substr({w}, 2), 'hw', '')")}"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN regexp_matches({w}, '^[a-z]') THEN upper(substr({w}, 1, 1)) || substr(replace(substr({code}, 2), '0', '') || '000', 1, 3) ELSE {w} END"


def _common(masks: str) -> str:
    """Length of the longest common subsequence of a text of ns characters with those whose places in it are the bits of ``masks``."""
    return f"ns - bit_count(list_reduce(list_prepend(v, {masks}), lambda w, u: ((w + (w & u)) | (w - (w & u))) & v))"


def compared() -> str:
    """Tables whole (x, y, r) and best (x, y, p): ratio, and best ratio of the shorter text with a window of the longer, of the pairs in cmp."""
    place = "list_reduce(list_transform(string_split(s, ''), lambda d, i: CASE WHEN c = d THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END), lambda p, q: p | q)"
    return (
        "uneven AS (SELECT DISTINCT x, y FROM cmp WHERE x <> y AND x <> '' AND y <> ''), "
        "turned AS (SELECT x, y, x AS s, y AS g FROM uneven WHERE length(x) <= length(y) UNION ALL SELECT x, y, y, x FROM uneven WHERE length(y) <= length(x)), "
        f"bits AS MATERIALIZED (SELECT x, y, length(s) AS ns, length(g) AS ng, (1::HUGEINT << length(s)) - 1 AS v, list_transform(string_split(g, ''), lambda c: {place}) AS m FROM turned), "
        f"whole AS MATERIALIZED (SELECT x, y, max(2.0::DOUBLE * ({_common('m')}) / (ns + ng)) AS r FROM bits GROUP BY x, y), "
        "win AS (SELECT x, y, ns, v, unnest(list_concat(list_transform(range(1, ns), lambda k: m[1:k]), list_transform(range(1, ng + 1), lambda k: m[k:k + ns - 1]))) AS part FROM bits), "
        f"best AS MATERIALIZED (SELECT x, y, max(2.0::DOUBLE * ({_common('part')}) / (ns + len(part))) AS p FROM win GROUP BY x, y)"
    )


def similar() -> str:
    """Table sim: the ratios of the distinct pairs (a, b) of names and of addresses in attrs."""
    put = lambda x: joined(f"list_sort({x})")
    ratio = lambda x, y, found: f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE {found} END"
    looked = lambda t, i, x, y: f"LEFT JOIN {t} {t[0]}{i} ON {t[0]}{i}.x = {x} AND {t[0]}{i}.y = {y}"
    forms = (("a", "b"), ("sa", "sb"), ("ra", "rb"))
    values = ", ".join(f"{ratio(x, y, f'w{i}.r')} AS r{i}, {ratio(x, y, f'b{i}.p')} AS p{i}" for i, (x, y) in enumerate(forms))
    joins = " ".join(looked(t, i, x, y) for i, (x, y) in enumerate(forms) for t in ("whole", "best"))
    gap = "CASE WHEN shared = '' THEN 0 ELSE 1 END"
    sa, sb = (f"(length(shared) + {gap} + length({x}))" for x in ("ra", "rb"))
    rest = f"1 - (length(ra) + length(rb)) * (1 - r2) / ({sa} + {sb})"
    one, two = (f"1 - CAST({gap} + length({x}) AS DOUBLE) / (length(shared) + {n})" for x, n in (("ra", sa), ("rb", sb)))
    token_set = f"CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE WHEN shared <> '' AND (ra = '' OR rb = '') THEN 1.0::DOUBLE WHEN shared = '' THEN {rest} ELSE greatest({rest}, {one}, {two}) END"
    apart = "(CAST(greatest(length(a), length(b)) AS DOUBLE) / least(length(a), length(b)))"
    scale = f"CASE WHEN {apart} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END"
    part_set = "CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE WHEN shared <> '' THEN 1.0::DOUBLE ELSE p2 END"
    wratio = f"CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN {apart} < 1.5 THEN greatest(r0, 0.95::DOUBLE * greatest(r1, ts)) ELSE greatest(r0, p0 * {scale}, greatest(p1, {part_set}) * 0.95::DOUBLE * {scale}) END"
    return (
        f"txt AS (SELECT a, b, {words('a')} AS la, {words('b')} AS lb FROM (SELECT name1 AS a, name2 AS b FROM attrs UNION SELECT addr1, addr2 FROM attrs)), "
        f"split AS (SELECT *, list_distinct(la) AS wa, list_distinct(lb) AS wb, {put('la')} AS sa, {put('lb')} AS sb FROM txt), "
        f"forms AS MATERIALIZED (SELECT a, b, wa, wb, sa, sb, {put('list_intersect(wa, wb)')} AS shared, {put('list_filter(wa, lambda w: NOT list_contains(wb, w))')} AS ra, {put('list_filter(wb, lambda w: NOT list_contains(wa, w))')} AS rb FROM split), "
        f"cmp AS ({' UNION '.join(f'SELECT {x} AS x, {y} AS y FROM forms' for x, y in forms)}), {compared()}, "
        f"looked AS (SELECT forms.*, {values} FROM forms {joins}), sets0 AS (SELECT *, {token_set} AS ts FROM looked), "
        f"sim AS MATERIALIZED (SELECT a, b, r0 AS fuzz_ratio, p0 AS partial_ratio, r1 AS token_sort_ratio, ts AS token_set_ratio, {wratio} AS wratio FROM sets0)"
    )



_ALT_SPACE = r"\s+"


def alt_clean(x: str) -> str:
    x = f"translate(lower(coalesce({x}, '')), {_q(_FROM2)}, {_q(_TO2)})"
    x = f"replace({x}, '&', ' and ')"
    return f"trim({_sub(_sub(x, r'[^\pL\pN_\s#\-]', ' '), _ALT_SPACE, ' ')})"


def alt_rules(x: str, rules: list[tuple[tuple[str, ...], str]], delete: bool = False) -> str:
    for ws, form in rules:
        x = _sub(x, rf"\b({'|'.join(ws)})\b", "" if delete else form)
    return f"trim({_sub(x, _ALT_SPACE, ' ')})"


def lexical_tokens(x: str) -> str:
    grams = f"CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) ELSE [] END"
    return f"list_concat(regexp_extract_all(lower({x}), '[\\pL\\pN_]+'), {grams})"


def _key(family: str, text: str, when: str) -> str:
    return f"CASE WHEN {when} THEN [{{'family': {_q(family)}, 'key': {text}, 'weight': CAST({V.KEY_WEIGHTS[family]} AS DOUBLE)}}] ELSE [] END"


def _keys() -> str:
    posted, numbered, long = "postal <> ''", "no <> ''", "length(one) >= 4"
    named = "len(core) > 0"
    made = [
        _key("FULL_NAME", "fullname", named),
        _key("SORTED_NAME", joined("list_sort(core)"), named),
        _key("NAME_FIRST2", "core[1] || ' ' || core[2]", "len(core) >= 2"),
        _key("PARTIAL_NAME", joined("list_sort(core)[1:3]"), "len(core) >= 3"),
        _key("NAME_ADDRNO", "fullname || '|' || no", f"{named} AND {numbered}"),
        _key("NAME1_ADDRNO", "one || '|' || no", f"{named} AND {numbered}"),
        _key("PREFIX4_ADDRNO", "substr(one, 1, 4) || '|' || no", f"{named} AND {numbered} AND {long}"),
        _key("NAME_POSTAL", "fullname || '|' || postal", f"{named} AND {posted}"),
        _key("POSTAL_NAME1", "postal || '|' || one", f"{named} AND {posted}"),
        _key("NAME1_POSTAL", "one || '|' || postal", f"{named} AND {posted}"),
        _key("PREFIX4_POSTAL", "substr(one, 1, 4) || '|' || postal", f"{named} AND {posted} AND {long}"),
        *[_key("NAME1_STREET", f"one || '|' || street[{i}]", f"{named} AND len(street) >= {i}") for i in (1, 2)],
        _key("ADDRNO_POSTAL", "no || '|' || postal", f"{numbered} AND {posted}"),
        *[_key("ADDRNO_STREET", f"no || '|' || street[{i}]", f"{numbered} AND len(street) >= {i}") for i in (1, 2, 3)],
        *[_key("ADDR_TOK_PAIR", f"street[{i}] || '|' || street[{i + 1}]", f"len(street) > {i}") for i in (1, 2)],
    ]
    out = made[0]
    for m in made[1:]:
        out = f"list_concat({out}, {m})"
    return out


def sql(fixtures: ModuleType) -> dict[str, str]:
    part, docs = fixtures.PART_ENTITIES.format(part="part"), fixtures.DOCUMENT_ENTITIES.format(documents="documents")
    ent = f"ent AS ({part})"
    both = f"ent AS (SELECT * FROM ({part}) a UNION ALL SELECT * FROM ({docs}) b)"
    truth = f"truth AS ({fixtures.PART_TRUTH.format(part='part')})"
    rec_of = lambda name, addr: f"rec AS MATERIALIZED (SELECT entity_id, source, {name} AS name_norm, {addr} AS addr_norm, trim(coalesce(country, '')) AS country FROM ent)"
    name, addr = name_norm("business_name"), addr_norm("business_address")
    rec, whole_rec = rec_of(f"substr({name}, 1, 88)", f"substr({addr}, 1, 160)"), rec_of(name, addr)
    name_tok, addr_tok = without(words("name_norm"), V.LEGAL_WORDS), without(words("addr_norm"), V.ADDRESS_STOP)
    tok_of = lambda most: (
        f"lists AS (SELECT entity_id, source, 'name' AS ns, ({name_tok}){most} AS l FROM rec UNION ALL SELECT entity_id, source, 'addr', ({addr_tok}){most} FROM rec), "
        "tok AS MATERIALIZED (SELECT entity_id, source, ns, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM lists)"
    )
    tok, whole_tok = tok_of(f"[1:{V.MAX_TOKENS}]"), tok_of("")
    df = "dfs AS MATERIALIZED (SELECT ns, token, count(*) AS df FROM tok WHERE source <> 'S1' GROUP BY ALL)"
    posts = (
        "once AS (SELECT entity_id, ns, token, min(pos) AS pos FROM tok WHERE source <> 'S1' GROUP BY ALL), "
        "posts AS (SELECT entity_id, ns, token, df, CAST(row_number() OVER (PARTITION BY entity_id, ns ORDER BY df, pos) AS INTEGER) AS rank FROM once JOIN dfs USING (ns, token) WHERE df <= 250 QUALIFY rank <= 4)"
    )
    probes = "probes AS (SELECT entity_id, ns, token, df, CAST(row_number() OVER (PARTITION BY entity_id, ns ORDER BY df, pos) AS INTEGER) AS rank, ln(1.0 + df) AS weight FROM tok JOIN dfs USING (ns, token) WHERE source = 'S1' AND df <= 250 QUALIFY rank <= 5)"
    rare = "rare AS (SELECT p.entity_id AS s1_id, t.entity_id AS target_id, ns AS channel, p.weight * CASE ns WHEN 'name' THEN 1.0 ELSE 0.8 END AS weight FROM probes p JOIN posts t USING (ns, token))"
    parts_of = lambda most: (
        f"parts1 AS (SELECT entity_id, source, {without(words('name_norm'), V.LEGAL_WORDS)} AS core, {words('addr_norm')} AS aw FROM rec), "
        "parts2 AS (SELECT *, list_filter(aw, lambda w: regexp_matches(w, '^[0-9]+$')) AS nums FROM parts1), "
        f"parts AS (SELECT entity_id, source, core, {joined('core')} AS fullname, coalesce(core[1], '') AS one, "
        "coalesce(list_filter(nums, lambda w: length(w) <= 5)[1], nums[1], '') AS no, coalesce(list_filter(nums, lambda w: length(w) IN (5, 6))[-1], '') AS postal, "
        f"list_filter(aw, lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 3 AND w NOT IN {_in(V.STREET_WORDS)}) AS street FROM parts2), "
        f"made AS (SELECT entity_id, source, {_keys()} AS ks FROM parts), "
        "each AS (SELECT entity_id, source, unnest(range(len(ks))) AS i, unnest(ks) AS k FROM made), "
        "uniq AS (SELECT entity_id, source, k, min(i) AS i FROM each GROUP BY ALL), "
        f"keys AS MATERIALIZED (SELECT entity_id, source, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1 AS INTEGER) AS ord, k.family AS family, k.key AS key, k.weight AS weight FROM uniq{most})"
    )
    parts, whole_parts = parts_of(f" QUALIFY ord < {V.MAX_KEYS}"), parts_of("")
    khits = "khits AS (SELECT q.entity_id AS s1_id, t.entity_id AS target_id, 'key' AS channel, q.weight FROM keys q JOIN keys t USING (family, key) WHERE q.source = 'S1' AND t.source <> 'S1')"
    cand = (
        "sums AS (SELECT s1_id, target_id, CAST(sum(weight) AS FLOAT) AS score FROM (SELECT * FROM rare UNION ALL SELECT * FROM khits) GROUP BY ALL), "
        f"cand AS MATERIALIZED (SELECT s1_id, target_id, score, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, {_number('target_id')}) AS INTEGER) AS rank FROM sums QUALIFY rank <= 30)"
    )
    blocked = f"{ent}, {rec}, {tok}, {df}, {posts}, {probes}, {rare}, {parts}, {khits}, {cand}"
    # without a bound on texts, tokens and keys
    whole = f"{ent}, {whole_rec}, {whole_tok}, {df}, {posts}, {probes}, {rare}, {whole_parts}, {khits}, {cand}"
    asked = "asked AS (SELECT entity_id AS s1_id FROM ent WHERE source = 'S1')"

    def per(found: str) -> str:
        return (
            f"{truth}, {asked}, found AS ({found}), "
            "pairs AS (SELECT coalesce(t.s1_id, f.s1_id) AS s1_id, t.target_id AS t, f.target_id AS f FROM (SELECT DISTINCT * FROM truth) t FULL JOIN (SELECT DISTINCT s1_id, target_id FROM found) f ON t.s1_id = f.s1_id AND t.target_id = f.target_id), "
            "per AS (SELECT a.s1_id, count(t) AS n_true, count(f) AS n_found, count(CASE WHEN t IS NOT NULL AND f IS NOT NULL THEN 1 END) AS n_hit FROM asked a LEFT JOIN pairs p ON a.s1_id = p.s1_id GROUP BY a.s1_id)"
        )

    fbeta = lambda t, f, h: f"CASE WHEN {t} = 0 THEN CASE WHEN {f} = 0 THEN 1.0 ELSE 0.0 END WHEN {h} = 0 THEN 0.0 ELSE 1.25 * ({h} / {f}) * ({h} / {t}) / (0.25 * ({h} / {f}) + {h} / {t}) END"
    prob = "probs AS (SELECT s1_id, target_id, rank, least(1.0, round(CAST(score AS DOUBLE), 4) / 100) AS prob FROM cand)"
    attrs = (
        "attrs AS (SELECT c.s1_id, c.target_id, c.score, a.name_norm AS name1, a.addr_norm AS addr1, a.country AS country1, b.name_norm AS name2, b.addr_norm AS addr2, b.country AS country2, b.source AS source2 "
        "FROM cand c JOIN rec a ON c.s1_id = a.entity_id JOIN rec b ON c.target_id = b.entity_id)"
    )
    sets = (
        f"sets1 AS (SELECT *, list_distinct({words('name1')}) AS n1, list_distinct({words('name2')}) AS n2, list_distinct({words('addr1')}) AS a1, list_distinct({words('addr2')}) AS a2, "
        f"list_distinct({trigrams('name1')}) AS g1, list_distinct({trigrams('name2')}) AS g2, split_part(name1, ' ', 1) AS w1, split_part(name2, ' ', 1) AS w2 FROM attrs), "
        "sets2 AS (SELECT *, list_filter(a1, lambda w: regexp_matches(w, '^[0-9]+$')) AS d1, list_filter(a2, lambda w: regexp_matches(w, '^[0-9]+$')) AS d2 FROM sets1), "
        "sets AS (SELECT *, list_filter(d1, lambda w: length(w) IN (5, 6)) AS p1, list_filter(d2, lambda w: length(w) IN (5, 6)) AS p2 FROM sets2)"
    )
    dbl = lambda c: f"CAST({c} AS DOUBLE)"
    feats = {
        "is_same_country": "CASE WHEN country1 <> '' AND country2 <> '' THEN CASE WHEN country1 = country2 THEN 1.0 ELSE 0.0 END ELSE 1.0 END",
        "is_source2": "CASE WHEN source2 = 'S2' THEN 1.0 ELSE 0.0 END",
        "name_token_jaccard": jaccard("n1", "n2"),
        "name_token_overlap": overlap("n1", "n2"),
        "addr_token_jaccard": jaccard("a1", "a2"),
        "addr_token_overlap": overlap("a1", "a2"),
        "name_3gram_jaccard": jaccard("g1", "g2"),
        "num_shared_numbers": "len(list_intersect(d1, d2))",
        "has_conflicting_numbers": "CASE WHEN len(d1) > 0 AND len(d2) > 0 AND len(list_intersect(d1, d2)) = 0 THEN 1.0 ELSE 0.0 END",
        "number_jaccard": jaccard("d1", "d2"),
        "postal_match": "CASE WHEN len(p1) > 0 AND len(p2) > 0 AND len(list_intersect(p1, p2)) > 0 THEN 1.0 ELSE 0.0 END",
        "postal_mismatch": "CASE WHEN len(p1) > 0 AND len(p2) > 0 AND len(list_intersect(p1, p2)) = 0 THEN 1.0 ELSE 0.0 END",
        "first_word_match": "CASE WHEN w1 <> '' AND w1 = w2 THEN 1.0 ELSE 0.0 END",
        "name_len_diff": "abs(length(name1) - length(name2))",
        "name_len_ratio": "least(length(name1), length(name2)) / greatest(length(name1), length(name2), 1)",
        "addr_len_diff": "abs(length(addr1) - length(addr2))",
        "addr_len_ratio": "least(length(addr1), length(addr2)) / greatest(length(addr1), length(addr2), 1)",
    }
    grid_of = lambda singles, matches: f"grid AS (SELECT t_singleton, t_match FROM (SELECT unnest({singles}::DOUBLE[]) AS t_singleton) a, (SELECT unnest({matches}::DOUBLE[]) AS t_match) b)"
    grid = grid_of(*decision.TWO_STAGE)
    swept = (
        "best AS (SELECT s1_id, max(prob) AS best FROM probs GROUP BY 1), "
        "marked AS (SELECT p.s1_id, p.prob, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS t FROM probs p LEFT JOIN (SELECT DISTINCT * FROM truth) t ON p.s1_id = t.s1_id AND p.target_id = t.target_id), "
        "counts AS (SELECT s1_id, t_singleton, t_match, count(*) AS found, sum(t) AS hit FROM marked JOIN best USING (s1_id), grid WHERE prob >= t_match AND best >= t_singleton GROUP BY ALL), "
        "trues AS (SELECT a.s1_id, count(t.target_id) AS n_true FROM asked a LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (s1_id) GROUP BY 1), "
        "cells AS (SELECT g.t_singleton, g.t_match, n.n_true, coalesce(c.found, 0) AS found, coalesce(c.hit, 0) AS hit FROM trues n CROSS JOIN grid g LEFT JOIN counts c ON n.s1_id = c.s1_id AND g.t_singleton = c.t_singleton AND g.t_match = c.t_match), "
        f"swept AS (SELECT t_singleton, t_match, round(avg({fbeta('n_true', 'found', 'hit')}), 6) AS macro_f, round(coalesce(sum(hit) / nullif(sum(found), 0), 0.0), 6) AS micro_precision, "
        "round(coalesce(sum(hit) / nullif(sum(n_true), 0), 0.0), 6) AS micro_recall, round(coalesce(avg(CASE WHEN n_true = 0 THEN CASE WHEN found = 0 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS singleton_accuracy FROM cells GROUP BY ALL)"
    )
    chosen = "chosen AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM probs) WHERE best >= 0.7 AND prob >= 0.62)"
    alt_name, alt_addr = alt_rules(alt_clean("business_name"), V.ALT_LEGAL), alt_rules(alt_clean("business_address"), V.ALT_ADDRESS)
    ltok = (
        f"norm AS (SELECT entity_id, source, lower(trim(coalesce(country, ''))) AS country, {alt_name} AS an, {alt_addr} AS aa FROM ent), "
        f"ltok AS MATERIALIZED (SELECT entity_id, source, country, 'name' AS field, unnest({lexical_tokens('an')}) AS token FROM norm UNION ALL SELECT entity_id, source, country, 'addr', unnest({lexical_tokens('aa')}) FROM norm)"
    )
    bm25 = (
        f"{ent}, {ltok}, tf AS (SELECT field, entity_id, country, token, count(*) AS tf FROM ltok WHERE source <> 'S1' GROUP BY ALL), "
        "lens AS (SELECT field, entity_id, count(*) AS len FROM ltok WHERE source <> 'S1' GROUP BY ALL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ent WHERE source <> 'S1'), "
        "raw AS (SELECT field, token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY field, token, n), means AS (SELECT field, avg(raw) AS mean FROM raw GROUP BY 1), "
        "idf AS (SELECT field, token, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN means USING (field)), sizes AS (SELECT field, sum(len) / max(n) AS avg_len FROM lens, n GROUP BY 1), "
        "ix AS (SELECT field, token, tf.entity_id AS target_id, country, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) AS weight FROM tf JOIN lens USING (field, entity_id) JOIN sizes USING (field) JOIN idf USING (field, token)), "
        "known AS (SELECT DISTINCT country FROM ix), "
        "lex AS (SELECT s1_id, target_id, score, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, target_id) AS INTEGER) AS rank FROM (SELECT q.entity_id AS s1_id, target_id, sum(weight * CASE q.field WHEN 'name' THEN 2.0 ELSE 1.0 END) AS score "
        "FROM ltok q JOIN ix ON q.field = ix.field AND q.token = ix.token WHERE q.source = 'S1' AND (q.country = ix.country OR q.country NOT IN (SELECT country FROM known)) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 5)"
    )
    tfidf = (
        f"texts AS (SELECT entity_id, source, {alt_name} || ' [SEP] ' || {alt_addr} || ' [SEP] ' || lower(trim(coalesce(country, ''))) AS text FROM ent), "
        "wtf AS (SELECT entity_id, source, token, count(*) AS tf FROM (SELECT entity_id, source, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_][\\pL\\pN_]+')) AS token FROM texts) GROUP BY ALL), "
        "widf AS (SELECT token, ln((1 + (SELECT count(*) FROM ent WHERE source <> 'S1')) / (1 + count(*))) + 1 AS idf FROM wtf WHERE source <> 'S1' GROUP BY token ORDER BY sum(tf) DESC, token LIMIT 5000), "
        "ww AS (SELECT entity_id, source, token, tf * idf AS w FROM wtf JOIN widf USING (token)), wn AS (SELECT entity_id, sqrt(sum(w * w)) AS norm FROM ww GROUP BY 1), "
        "wv AS MATERIALIZED (SELECT entity_id, source, token, w / norm AS w FROM ww JOIN wn USING (entity_id)), "
        "den AS (SELECT s1_id, target_id, score, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, target_id) AS INTEGER) AS rank FROM (SELECT q.entity_id AS s1_id, t.entity_id AS target_id, sum(q.w * t.w) AS score FROM wv q JOIN wv t USING (token) WHERE q.source = 'S1' AND t.source <> 'S1' GROUP BY ALL) QUALIFY rank <= 5)"
    )
    report = "round(avg(CASE WHEN n_true > 0 THEN n_hit / n_true END), 6) AS mean_recall, count(*) FILTER (n_true > 0 AND n_hit = 0) AS zero_recall, count(*) FILTER (n_true > 0 AND n_hit = n_true) AS full_recall, count(*) FILTER (n_true = 0) AS singletons, count(*) FILTER (n_found = 0) AS without_candidates"
    quality = "round(coalesce(sum(n_hit) / nullif(sum(n_true), 0), 1.0), 6) AS pair_completeness, round(1 - sum(n_found) / (count(*) * (SELECT count(*) FROM ent WHERE source <> 'S1')), 8) AS reduction_ratio, round(sum(n_found) / count(*), 6) AS avg_candidates, CAST(sum(n_found) AS BIGINT) AS candidate_pairs, CAST(sum(n_true) AS BIGINT) AS true_pairs, CAST(sum(n_hit) AS BIGINT) AS recalled_pairs"
    macro = f"round(avg({fbeta('n_true', 'n_found', 'n_hit')}), 6) AS macro_f, round(sum(n_hit) / sum(n_found), 6) AS micro_precision, round(sum(n_hit) / sum(n_true), 6) AS micro_recall, round(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_found = 0 THEN 1.0 ELSE 0.0 END END), 6) AS singleton_accuracy, count(*) FILTER (n_true = 0) AS true_singletons, count(*) FILTER (n_found = 0) AS predicted_singletons, count(*) AS n_queries"
    jw = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE round(jaro_winkler_similarity({a}, {b}), 6) END"
    alike = "JOIN sim sn ON sn.a = name1 AND sn.b = name2 JOIN sim sa ON sa.a = addr1 AND sa.b = addr2"
    exact = lambda a, b: f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE jaro_winkler_similarity({a}, {b}) END)"
    every = feats | {"blocking_score": "score", "name_wratio": "sn.wratio"}
    every |= {f"{c}_{n}": f"{t}.{n}" for t, c in (("sn", "name"), ("sa", "addr")) for n in FUZZ}
    every |= {"name_jaro_winkler": exact("name1", "name2"), "addr_jaro_winkler": exact("addr1", "addr2"), "name_addr_fuzz_prod": "sn.token_set_ratio * sa.token_set_ratio"}
    every |= {"first_word_jw": f"CASE WHEN w1 = '' OR w2 = '' THEN 0.0::DOUBLE ELSE {exact('w1', 'w2')} END", "name_addr_jw_prod": f"{exact('name1', 'name2')} * {exact('addr1', 'addr2')}"}
    every["first_word_soundex"] = f"CASE WHEN w1 <> '' AND w2 <> '' AND {soundex('w1')} = {soundex('w2')} THEN 1.0 ELSE 0.0 END"
    matched = "SELECT s1_id, target_id FROM chosen"
    broken = (
        "lines AS (SELECT p_partkey AS k, 'S1-' || (CASE WHEN p_partkey % 50 = 5 THEN p_partkey + 1 ELSE p_partkey END) AS s1_id, p_partkey % 50 <> 1 AS has_tab, "
        "CASE p_partkey % 50 WHEN 2 THEN ['S1-9', 'S2-' || p_partkey] WHEN 3 THEN ['X-1', 'S2-1'] WHEN 4 THEN ['S2-1', 'S2-1'] WHEN 5 THEN ['S3-777777'] ELSE [] END AS ids FROM part), "
        "good AS (SELECT * FROM lines WHERE has_tab), ids AS (SELECT DISTINCT unnest(ids) AS id FROM good), "
        "bad AS (SELECT 'no_tab' AS rule, s1_id AS item FROM lines WHERE NOT has_tab UNION SELECT 'duplicate_row', s1_id FROM good GROUP BY s1_id HAVING count(*) > 1 "
        "UNION SELECT 'repeated_id', s1_id FROM good WHERE len(ids) <> len(list_distinct(ids)) UNION SELECT 'self_match', id FROM ids WHERE id LIKE 'S1-%' UNION SELECT 'wrong_prefix', id FROM ids WHERE NOT regexp_matches(id, '^S[123]-') "
        "UNION SELECT 'missing_s1', entity_id FROM ent WHERE source = 'S1' AND entity_id NOT IN (SELECT s1_id FROM good) UNION SELECT 'extra_s1', s1_id FROM good WHERE s1_id NOT IN (SELECT entity_id FROM ent WHERE source = 'S1') "
        "UNION SELECT 'unknown_id', id FROM ids WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM ent WHERE source <> 'S1'))"
    )
    return {
        "source_scan": f"WITH {both} SELECT source, entity_id, business_name, business_address, country FROM ent",
        "tsv_scan": f"WITH {ent} SELECT source, entity_id, business_name, business_address, country FROM ent",
        "row_counts": f"WITH {ent} SELECT source, count(*) AS n FROM ent GROUP BY source",
        "kept_entities": f"WITH {ent} SELECT source, entity_id, business_name, business_address, country FROM ent",
        "composite_text": f"WITH {both} SELECT entity_id, trim(coalesce(business_name, '') || ' ' || coalesce(business_address, '')) AS composite FROM ent",
        "id_hashes": f"WITH {both}, h AS (SELECT entity_id, list_reduce(list_prepend({OFFSET}::HUGEINT, list_transform(string_split(entity_id, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * {PRIME}::HUGEINT) % {1 << 64}::HUGEINT) AS h FROM ent) "
        f"SELECT entity_id, CAST(CASE WHEN h >= {1 << 63}::HUGEINT THEN h - {1 << 64}::HUGEINT ELSE h END AS BIGINT) AS id_hash FROM h",
        "country_counts": f"WITH {both} SELECT source, trim(coalesce(country, '')) AS country, count(*) AS n FROM ent GROUP BY ALL",
        "base_clean": f"WITH {both} SELECT entity_id, {clean('business_name')} AS name_clean, {clean('business_address')} AS addr_clean FROM ent",
        "normalize_name": f"WITH {both} SELECT entity_id, {name_norm('business_name')} AS name_norm, {joined(without(words(phrased(clean('business_name'))), V.LEGAL_WORDS))} AS name_core FROM ent",
        "normalize_addr": f"WITH {both} SELECT entity_id, {addr_norm('business_address')} AS addr_norm FROM ent",
        "numbers": f"WITH {ent}, a AS (SELECT entity_id, {addr_norm('business_address')} AS x FROM ent) SELECT entity_id, {joined(r'''regexp_extract_all(x, '\d+')''')} AS all_numbers, {joined(r'''regexp_extract_all(x, '\d{5}(?:\d{1})?')''')} AS postal_codes FROM a",
        "char_trigrams": f"WITH {ent}, {rec}, g AS (SELECT entity_id, {trigrams('name_norm')} AS g FROM rec) SELECT entity_id, CAST(len(g) AS INTEGER) AS n_grams, {joined('list_sort(list_distinct(g))', '/')} AS grams FROM g",
        "record_tokens": f"WITH {ent}, {rec}, {tok} SELECT entity_id, ns, pos, token FROM tok",
        "alt_normalize": f"WITH {ent} SELECT entity_id, {alt_clean('business_name')} AS clean, {alt_name} AS name_alt, {alt_rules(alt_clean('business_name'), V.ALT_LEGAL, True)} AS name_alt_core, {alt_addr} AS addr_alt, "
        + r"coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(business_address, '\b\d+\b')), lambda x: {'p': list_position(regexp_extract_all(business_address, '\b\d+\b'), x), 'x': x})), lambda s: s.x), ' '), '') AS alt_numbers, "
        + r"coalesce(regexp_extract_all(business_address, '\b\d{6}\b')[-1], regexp_extract_all(business_address, '\b\d{5}\b')[-1], '') AS alt_postal, "
        + f"{alt_name} || ' [SEP] ' || {alt_addr} || ' [SEP] ' || lower(trim(coalesce(country, ''))) AS composite FROM ent",
        "token_df": f"WITH {ent}, {rec}, {tok}, {df} SELECT ns, token, df FROM dfs",
        "rare_doc_tokens": f"WITH {ent}, {rec}, {tok}, {df}, {posts} SELECT entity_id, ns, token, df, rank FROM posts",
        "rare_query_tokens": f"WITH {ent}, {rec}, {tok}, {df}, {probes} SELECT entity_id, ns, token, df, rank, round(weight, 6) AS weight FROM probes",
        "composite_keys": f"WITH {ent}, {rec}, {parts} SELECT entity_id, ord, family, key, weight FROM keys",
        "key_posting_stats": f"WITH {ent}, {rec}, {parts} SELECT family, count(*) AS distinct_keys, round(avg(n), 6) AS mean_postings, max(n) AS max_postings FROM (SELECT family, key, count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY ALL) GROUP BY family",
        "rare_candidates": f"WITH {ent}, {rec}, {tok}, {df}, {posts}, {probes}, {rare} SELECT s1_id, target_id, channel, count(*) AS hits, round(sum(weight), 6) AS weight FROM rare GROUP BY ALL",
        "composite_candidates": f"WITH {ent}, {rec}, {parts}, {khits}, sums AS (SELECT s1_id, target_id, CAST(sum(weight) AS FLOAT) AS score FROM khits GROUP BY ALL) "
        f"SELECT s1_id, target_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, {_number('target_id')}) AS INTEGER) AS rank, round(CAST(score AS DOUBLE), 4) AS score FROM sums QUALIFY rank <= 30",
        "exact_name_blocks": f"WITH ent AS ({docs}), {rec}, {parts} SELECT q.entity_id AS s1_id, count(*) AS n_targets FROM keys q JOIN keys t USING (family, key) WHERE family = 'FULL_NAME' AND q.source = 'S1' AND t.source <> 'S1' GROUP BY 1",
        "blocked_topk": f"WITH {whole} SELECT s1_id, target_id, rank, round(CAST(score AS DOUBLE), 4) AS score FROM cand",
        "truth_pairs": f"WITH {truth} SELECT DISTINCT s1_id, target_id FROM truth",
        "truth_stats": f"WITH {ent}, {truth}, {asked} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS unresolved, (SELECT count(*) FROM asked WHERE s1_id NOT IN (SELECT s1_id FROM truth)) AS singletons FROM truth",
        "label_candidates": f"WITH {blocked}, {truth} SELECT c.s1_id, c.target_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM cand c LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.target_id = t.target_id",
        "pair_completeness": f"WITH {whole}, {per('SELECT s1_id, target_id FROM cand')} SELECT {quality} FROM per",
        "blocking_report": f"WITH {whole}, {per('SELECT s1_id, target_id FROM cand')} SELECT {report} FROM per",
        "macro_f05": f"WITH {whole}, {prob}, {chosen}, {per(matched)} SELECT {macro} FROM per",
        "entity_scores": f"WITH {whole}, {prob}, {chosen}, {per(matched)} SELECT s1_id, n_true, n_found, n_hit, round({fbeta('n_true', 'n_found', 'n_hit')}, 6) AS f_beta FROM per",
        "singleton_stats": f"WITH {ent}, {truth}, {asked} SELECT n_true, count(*) AS n_queries FROM (SELECT a.s1_id, count(t.target_id) AS n_true FROM asked a LEFT JOIN truth t USING (s1_id) GROUP BY 1) GROUP BY 1",
        "missed_pairs": f"WITH {blocked}, {truth}, m AS (SELECT DISTINCT s1_id, target_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.s1_id = t.s1_id AND c.target_id = t.target_id)) "
        "SELECT s1_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY target_id) AS n FROM m) WHERE n <= 2 ORDER BY s1_id, target_id LIMIT 15",
        "key_recall": f"WITH {ent}, {whole_rec}, {whole_parts}, {khits}, {truth}, h AS (SELECT DISTINCT q.family, q.entity_id AS s1_id, t.entity_id AS target_id FROM keys q JOIN keys t USING (family, key) JOIN truth u ON u.s1_id = q.entity_id AND u.target_id = t.entity_id) "
        "SELECT family, count(*) AS hit, round(count(*) / (SELECT count(*) FROM truth), 6) AS recall FROM h GROUP BY family",
        "token_overlap_features": f"WITH {blocked}, {attrs}, {sets} SELECT s1_id, target_id, " + ", ".join(f"round({dbl(f'({x})')}, 6) AS {n}" for n, x in feats.items()) + " FROM sets",
        "soundex_match": f"WITH {blocked}, {attrs}, {sets} SELECT s1_id, target_id, CASE WHEN w1 <> '' AND w2 <> '' AND {soundex('w1')} = {soundex('w2')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first_word_soundex FROM sets",
        "jaro_winkler": f"WITH {whole}, {attrs} SELECT s1_id, target_id, {jw('name1', 'name2')} AS name_jw, {jw('addr1', 'addr2')} AS addr_jw FROM attrs",
        "fuzz_ratios": f"WITH {whole}, {attrs}, {similar()} SELECT s1_id, target_id, " + ", ".join(f"round({t}.{n}, 6) AS {c}_{n}" for t, c in (("sn", "name"), ("sa", "addr")) for n in FUZZ) + f" FROM attrs {alike}",
        "wratio": f"WITH {blocked}, {attrs}, {similar()} SELECT s1_id, target_id, round(sn.wratio, 6) AS name_wratio FROM attrs {alike}",
        "pair_features": f"WITH {whole}, {attrs}, {similar()}, {sets} SELECT s1_id, target_id, " + ", ".join(f"round(CAST(CAST(({x}) AS FLOAT) AS DOUBLE), 6) AS {n}" for n, x in every.items()) + f" FROM sets {alike}",
        "two_stage_decision": f"WITH {blocked}, {prob}, {chosen} SELECT s1_id, target_id FROM chosen",
        "threshold_grid": f"WITH {blocked}, {truth}, {asked}, {prob}, {grid}, {swept} SELECT * FROM swept",
        "single_threshold_grid": f"WITH {blocked}, {truth}, {asked}, {prob}, {grid_of([0.0], decision.SINGLE)}, {swept} SELECT * FROM swept",
        "wide_threshold_grid": f"WITH {blocked}, {truth}, {asked}, {prob}, {grid_of(*decision.TWO_STAGE_WIDE)}, {swept} SELECT * FROM swept",
        "query_slices": f"WITH {ent}, {asked}, n AS (SELECT s1_id, row_number() OVER (ORDER BY {_number('s1_id')}) AS r, count(*) OVER () AS n FROM asked) SELECT s1_id, CASE WHEN r <= floor(0.8 * n + 1e-9) THEN 'train' ELSE 'validate' END AS part FROM n",
        "query_sample": f"WITH {ent}, {asked} SELECT s1_id FROM asked ORDER BY md5('42|' || s1_id), s1_id LIMIT 100",
        "best_threshold": f"WITH {whole}, {truth}, {asked}, {prob}, {grid}, {swept} SELECT t_singleton, t_match, macro_f FROM swept ORDER BY macro_f DESC, t_singleton, t_match LIMIT 1",
        "probability_profile": f"WITH {whole}, {prob}, m AS (SELECT max(prob) AS p FROM probs GROUP BY s1_id) SELECT round(quantile_cont(p, 0.05), 6) AS p05, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.2), 6) AS p20, "
        + ", ".join(f"round(avg(CASE WHEN p < {b} THEN 1.0 ELSE 0.0 END), 6) AS below_{round(b * 100):02d}" for b in (0.05, 0.1, 0.15, 0.2, 0.3, 0.4))
        + " FROM m",
        "roc_auc": f"WITH {blocked}, {truth}, l AS (SELECT round(CAST(c.score AS DOUBLE), 4) AS s, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS y FROM cand c LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.target_id = t.target_id), "
        "r AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM l GROUP BY s), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r) "
        "SELECT round(sum(p * (below + n / 2)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS roc_auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM w",
        "bm25_topk": f"WITH {bm25} SELECT s1_id, target_id, rank, round(score, 4) AS score FROM lex",
        "tfidf_topk": f"WITH {ent}, {tfidf} SELECT s1_id, target_id, rank, round(score, 6) AS score FROM den",
        "embedding_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT CAST(q.vec_id AS VARCHAR) AS s1_id, CAST(t.vec_id AS VARCHAR) AS target_id, round(list_cosine_similarity(q.e, t.e), 9) AS s FROM v q, v t WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id) "
        "SELECT s1_id, target_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY s DESC, target_id) AS INTEGER) AS rank, round(s, 6) AS score FROM p QUALIFY rank <= 5",
        "hybrid_interleave": f"WITH {bm25}, {tfidf}, places AS (SELECT s1_id, target_id, min(place) AS place FROM (SELECT s1_id, target_id, 2 * rank AS place FROM lex UNION ALL SELECT s1_id, target_id, 2 * rank + 1 FROM den) GROUP BY ALL) "
        "SELECT s1_id, target_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY place) AS INTEGER) AS rank FROM places QUALIFY rank <= 8",
        "submission_rows": f"WITH {blocked}, {asked}, {prob}, {chosen} SELECT a.s1_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS matched_entity_ids FROM asked a LEFT JOIN chosen c USING (s1_id) GROUP BY a.s1_id",
        "candidate_rows": f"WITH {whole}, {asked} SELECT a.s1_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS candidate_entity_ids FROM asked a LEFT JOIN cand c USING (s1_id) GROUP BY a.s1_id",
        "outside_candidates": f"WITH {whole}, {truth} SELECT DISTINCT s1_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.s1_id = t.s1_id AND c.target_id = t.target_id)",
        "match_counters": f"WITH {blocked}, {asked}, {prob}, {chosen}, n AS (SELECT a.s1_id, count(c.target_id) AS n FROM asked a LEFT JOIN chosen c USING (s1_id) GROUP BY 1) "
        "SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS ids, count(*) FILTER (n > 0) AS non_empty, count(*) AS rows_read, count(*) FILTER (n = 0) AS empty_read, count(*) FILTER (n > 0) AS non_empty_read FROM n",
        "result_files": "SELECT * FROM (VALUES ('whole', 0::BIGINT, 0::BIGINT, 0::BIGINT), ('unchecked', 0, 1, 0), ('swapped', 2, 0, 1), ('missing', 1, 1, 1), ('blank', 1, 0, 1), ('commas', 1, 0, 1)) AS t (file, errors, warnings, exit_code)",
        "validate_submission": f"WITH {ent}, {broken} SELECT rule, count(*) AS n, array_to_string(list_sort(list(item))[1:5], ', ') AS examples FROM bad GROUP BY rule",
    }
