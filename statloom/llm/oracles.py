"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from statloom.llm import fingerprints as fp
from statloom.llm import licences

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: Sequence[str]) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def fingerprints() -> str:
    words = lambda t: f"list_filter(string_split_regex(translate({t}, '{_UP}', '{_LOW}'), '{_SPACE}'), lambda x: x <> '')"
    one = lambda run: f"left(md5(array_to_string({run}, ' ')), {fp.DIGITS})"
    hashes = f"CASE WHEN len(w) >= {fp.WORDS} THEN list_transform(range(1, len(w) - {fp.WORDS - 2}), lambda i: {one(f'w[i:i+{fp.WORDS - 1}]')}) WHEN len(w) > 0 THEN [{one('w')}] ELSE [] END"
    sketch = f"list_sort(list_distinct({hashes}))[1:{fp.K}]"
    near = lambda a, b: f"(SELECT CASE WHEN len(u) = 0 THEN 1.0 ELSE len(list_filter(u, lambda x: list_contains({a}, x) AND list_contains({b}, x))) / len(u)::DOUBLE END FROM (SELECT list_sort(list_distinct(list_concat({a}, {b})))[1:{fp.K}] u))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
 o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) nt, length(t) n FROM d),
 e AS (SELECT doc_id, t, n, left(t, n - n // 4) || left(nt, n // 4) et FROM o),
 a AS (SELECT doc_id, {sketch} s FROM (SELECT doc_id, {words('t')} w FROM e)), b AS (SELECT doc_id, {sketch} s FROM (SELECT doc_id, {words('et')} w FROM e)),
 n AS (SELECT doc_id, s, coalesce(lead(s) OVER (ORDER BY doc_id), first_value(s) OVER (ORDER BY doc_id)) ns FROM a)
SELECT e.doc_id, e.n::BIGINT n_chars, sha256(et) edited_sha256, array_to_string(n.s, '') fingerprint, array_to_string(b.s, '') edited_fingerprint,
 {near('n.s', 'b.s')} near_edited, {near('n.s', 'n.ns')} near_next FROM e JOIN n USING (doc_id) JOIN b USING (doc_id)"""


def mixture(domains: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int, seed: int) -> str:
    weight = lambda c: "1.0" if c not in weights else "CASE " + " ".join(f"WHEN {c} = {_text(k)} THEN {float(v)}" for k, v in weights[c].items() if k != "*") + f" ELSE {float(weights[c].get('*', 0))} END"
    levels = ("domain", "lang", "source")
    live = " * ".join(f"({weight(c)} > 0)::INT" for c in levels)
    out = f"""WITH d AS (SELECT doc_id, lang, source, {_list(domains)}[coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 3 + 1] AS domain,
 len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) tokens FROM documents),
 t0 AS (SELECT domain, lang, source, sum(tokens)::DOUBLE have, sum(tokens) * {float(epochs)} * {live} cap, least(floor(sum(sum(tokens)) OVER () * {share}), sum(sum(tokens) * {float(epochs)} * {live}) OVER ()) given FROM d GROUP BY domain, lang, source)"""
    for i, c in enumerate(levels):
        above, path = ", ".join(["1", *levels[:i]]), ", ".join(levels[: i + 1])
        out += f""",
 n{i} AS (SELECT {path}, sum(cap) c, max({weight(c)}) w, max(given) b FROM t{i} GROUP BY {path} HAVING max({weight(c)}) > 0 AND sum(cap) > 0),
 l{i} AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY {above} ORDER BY c / w, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {above} ORDER BY c / w, {c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) l FROM n{i}),
 g{i} AS (SELECT {path}, least(c, w * max(l) OVER (PARTITION BY {above})) g FROM l{i}),
 t{i + 1} AS (SELECT domain, lang, source, have, cap, coalesce(g, 0) given FROM t{i} LEFT JOIN g{i} USING ({path}))"""
    return out + f""",
 q AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN floor(floor(given + 1e-6) / have) ELSE 0 END::BIGINT whole, floor(given + 1e-6) - CASE WHEN have > 0 THEN floor(floor(given + 1e-6) / have) ELSE 0 END * have rest FROM t3),
 k AS (SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}/' || whole || '/' || doc_id)) upto FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens::BIGINT tokens, (whole + (rest > 0 AND upto <= rest)::INT)::BIGINT copies FROM k"""


def licence_scan() -> str:
    """Sentences split and unwrapped as the operator's; doubled bars between lines, so that each of two neighbours has its own."""
    known, rules = licences.SENTENCES, licences.RULES
    sentence = f"list_filter(string_split_regex(lower(coalesce(text, '')), {_text(licences.STOP)}), lambda s: regexp_matches(s, {_text(licences.hints(known))}))"
    plain = f"trim(regexp_replace(regexp_replace(regexp_replace(s, {_text(licences.LINE)}, chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', '||', 'g'))"
    wrapped, texts = "s", {}
    for text, name in known.items():
        texts.setdefault(name, []).append(text.replace(" ", r"(?: |\|\|)"))
    for name, some in texts.items():
        wrapped = f"regexp_replace({wrapped}, {_text(rf'(^|[|])(?:{chr(124).join(some)})([|]|$)')}, '\\1#{name}\\2', 'g')"
    sentence = f"flatten(list_transform(list_transform({sentence}, lambda s: {plain}), lambda s: string_split(CASE WHEN contains(s, '||') THEN {wrapped} ELSE s END, '||')))"
    code = f"CASE WHEN starts_with(s, '#') THEN s[2] ELSE coalesce({_list(list(known.values()))}[list_position({_list(list(known))}, s)], CASE WHEN regexp_matches(s, {_text(licences.TELLS)}) THEN '?' ELSE '' END) END"
    out = f"WITH a AS (SELECT doc_id, array_to_string(list_transform({sentence}, lambda s: {code}), '') c FROM documents), r0 AS (SELECT doc_id, c, replace(c, '?', '') ids, replace(c, '?', '') rest, []::VARCHAR[] names FROM a)"
    for i, (name, pattern) in enumerate(rules):
        out += f", r{i + 1} AS (SELECT doc_id, c, ids, regexp_replace(rest, {_text(pattern)}, '-', 'g') rest, CASE WHEN regexp_matches(rest, {_text(pattern)}) AND NOT list_contains(names, {_text(name)}) THEN list_append(names, {_text(name)}) ELSE names END names FROM r{i})"
    return out + f" SELECT doc_id, ids sentence_ids, array_to_string(names, ',') licences, length(c) - length(ids) n_unknown FROM r{len(rules)}"


def url_filter(rules: Sequence[tuple[str, str, str]]) -> str:
    values = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in rules)
    best = "(length(r.host || r.path), length(r.host))"
    return rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
 r(host, path, verdict) AS (VALUES {values})
SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, {best}) rule, coalesce(arg_max(r.verdict, {best}), 'allow') verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1, 2, 3"""


def jaccard(words: int, num: int, den: int) -> str:
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SPACE}'), lambda x: x <> '') w FROM documents),
 h AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i+{words - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM d),
 u AS MATERIALIZED (SELECT doc_id, len(s) n, unnest(s) s FROM h),
 e AS MATERIALIZED (SELECT a.doc_id a, b.doc_id b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING {den} * count(*) >= {num} * (any_value(a.n) + any_value(b.n) - count(*))),
 r AS (SELECT doc_id, doc_id v FROM h UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.v)
SELECT h.doc_id, len(any_value(h.s))::BIGINT n_shingles, min(r.v) component_id FROM h JOIN r USING (doc_id) GROUP BY h.doc_id"""


def repeats(span: int) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, len(w) - {span - 2})) i FROM d WHERE len(w) >= {span}),
 h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{span - 1}], ' ')) h FROM i),
 f AS (SELECT doc_id, list(i) f FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) m FROM h) WHERE m < doc_id GROUP BY 1),
 k AS (SELECT d.doc_id, w, CASE WHEN f IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_has_any(f, range(j - {span - 1}, j + 1))) END k FROM d LEFT JOIN f USING (doc_id))
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - len(k))::BIGINT n_removed, sha256(array_to_string(k, ' ')) kept_sha256 FROM k"""


def filter_audit() -> str:
    """Failures as five columns; every order's steps by counting documents that pass all filters before."""
    words = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
 l AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY 1),
 w AS (SELECT *, {words} w, min(doc_id) OVER (PARTITION BY t) least FROM d),
 f AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END,
   CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
   CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
   CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
   CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END) fails FROM w LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, fails, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM f GROUP BY 1, 2),
 o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) filter_order FROM {letters} a(c), {letters} b(c), {letters} c(c), {letters} d(c), {letters} e(c)
   WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
 s AS (SELECT filter_order, step, filter_order[step] own, filter_order[1:step-1] prior FROM o, (SELECT unnest(range(1, 6)) step)),
 x AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) hit, len(list_intersect(string_split(fails, ''), string_split(prior, ''))) > 0 AND prior <> '' AND fails <> '' gone FROM g, s),
 p AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT removed,
   coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT unique_fails,
   coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT toxic_lost FROM x GROUP BY ALL)
 SELECT part, filter_order, step::INTEGER step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT shapley FROM p"""


def top_products(every: int, top: int, scale: int) -> str:
    """All products of the queries with all vectors."""
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) v FROM embeddings
   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 n AS (SELECT len(v) n FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), v AS (SELECT e.* FROM e, n WHERE len(v) = n),
 q AS (SELECT vec_id query_id, min(v) q FROM v WHERE vec_id % {every} = 0 GROUP BY 1),
 s AS (SELECT query_id, vec_id, list_inner_product(q, v)::BIGINT score FROM q, v WHERE query_id <> vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
 SELECT query_id, rank::INTEGER rank, vec_id, score FROM r WHERE rank <= {top}"""
