"""The string kernels and the record normalization in DuckDB SQL, to check the engine's against.

Kernels take a table of comparisons (id columns, kind, x, y) in long form: one
row per kind of feature, or several where a feature is the best of several
ratios. Everything is written from the definitions and shares no code with the
kernels.
"""

from __future__ import annotations

from ..functions import lexicon as lx


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' '), '')"


def listed(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def map_words(c: str, names: dict[str, str]) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"
    return joined(f"list_transform({words(c)}, lambda w: coalesce({table}[w], w))")


# --- longest common subsequence ----------------------------------------------


def _by_bits(a: str, b: str) -> str:
    """Bit-parallel rows in a 128-bit integer; a has at most 125 characters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    met = f"list_transform(string_split({b}, ''), lambda c: list_reduce(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END), lambda u, v: u | v, 0::HUGEINT))"
    return f"length({a}) - bit_count(list_reduce({met}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full}))"


def _by_rows(a: str, b: str) -> str:
    """The usual table, row by row."""
    cell = f"CASE WHEN unicode(substr({a}, i[1], 1)) = c[1] THEN r[i[1]] + 1 ELSE greatest(n[i[1]], r[i[1] + 1]) END"
    row = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda n, i: list_append(n, {cell}), [0::BIGINT])"
    return f"list_last(list_reduce(list_transform(string_split({b}, ''), lambda c: [unicode(c)::BIGINT]), lambda r, c: {row}, list_transform(range(0, length({a}) + 1), lambda z: 0::BIGINT)))"


def lcs(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN length({a}) <= 125 THEN {_by_bits(a, b)} WHEN length({b}) <= 125 THEN {_by_bits(b, a)} ELSE {_by_rows(a, b)} END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


#: Letters beyond ASCII in the driver's tables. The SQL engine's kernel compares bytes, so each becomes one byte that no text holds.
_WIDE = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"


def jaro_winkler(a: str, b: str) -> str:
    narrow = "".join(map(chr, range(1, len(_WIDE) + 1)))
    return f"jaro_winkler_similarity(translate({a}, '{_WIDE}', '{narrow}'), translate({b}, '{_WIDE}', '{narrow}'))"


# --- comparisons in long form --------------------------------------------------


def _sorted(c: str) -> str:
    return joined(f"list_sort({words(c)})")


def compare(table: str, ids: str, ratios: dict[str, tuple[str, str]], sorts: dict[str, tuple[str, str]], sets: dict[str, tuple[str, str]], partials: dict[str, tuple[str, str]] | None = None) -> str:
    """CTEs ending in `compared` (ids, kind, r) for columns of a table; kinds map to pairs of column expressions."""
    plain = [f"SELECT {ids}, '' AS kind, '' AS x, '' AS y, NULL::DOUBLE AS fixed FROM {table} WHERE false"]
    plain += [f"SELECT {ids}, '{k}', {a}, {b}, NULL FROM {table}" for k, (a, b) in ratios.items()]
    plain += [f"SELECT {ids}, '{k}', {_sorted(a)}, {_sorted(b)}, NULL FROM {table}" for k, (a, b) in sorts.items()]
    split = " UNION ALL ".join(f"SELECT {ids}, '{k}' AS kind, list_distinct({words(a)}) AS a, list_distinct({words(b)}) AS b FROM {table}" for k, (a, b) in sets.items())
    out = []
    if sets:
        out.append(f"""sets AS ({split}), bases AS (
            SELECT {ids}, kind, {joined("list_sort(list_intersect(a, b))")} AS base, {joined("list_sort(list_filter(a, lambda w: NOT list_contains(b, w)))")} AS l, {joined("list_sort(list_filter(b, lambda w: NOT list_contains(a, w)))")} AS r, len(a) = 0 OR len(b) = 0 AS none FROM sets
        ), sides AS (
            SELECT {ids}, kind, base, trim(base || ' ' || l) AS one, trim(base || ' ' || r) AS two, CASE WHEN none THEN 0.0::DOUBLE WHEN base <> '' AND (l = '' OR r = '') THEN 100.0::DOUBLE END AS fixed FROM bases
        )""")
        plain += [f"SELECT {ids}, kind, one, two, fixed FROM sides", f"SELECT {ids}, kind, base, one, NULL FROM sides WHERE fixed IS NULL AND base <> ''", f"SELECT {ids}, kind, base, two, NULL FROM sides WHERE fixed IS NULL AND base <> ''"]
    if partials:
        both = " UNION ALL ".join(f"SELECT {ids}, '{k}' AS kind, {a} AS a, {b} AS b FROM {table}" for k, (a, b) in partials.items())
        out.append(f"""ends AS ({both}), short AS (
            SELECT {ids}, kind, a AS s, b AS l FROM ends WHERE length(a) <= length(b) UNION ALL SELECT {ids}, kind, b, a FROM ends WHERE length(b) <= length(a)
        ), spans AS (
            SELECT {ids}, kind, s, l, unnest(range(2 - length(s), length(l) + 1)) AS pos FROM short WHERE s <> ''
        )""")
        # windows of the shorter one's length; at either end those that stick out are cut
        plain += [f"SELECT {ids}, kind, s, substr(l, greatest(pos, 1), (least(pos + length(s), length(l) + 1) - greatest(pos, 1))), NULL FROM spans", f"SELECT {ids}, kind, '', '', CASE WHEN l = '' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END FROM short WHERE s = ''"]
    out.append(f"sorted AS ({' UNION ALL '.join(plain)}), compared AS (SELECT {ids}, kind, max(coalesce(fixed, {ratio('x', 'y')})) AS r FROM sorted GROUP BY ALL)")
    return ", ".join(out)


def pivoted(ids: str, kinds: list[str]) -> str:
    return f"wide AS (SELECT {ids}, " + ", ".join(f"max(r) FILTER (WHERE kind = '{k}') AS {k}" for k in kinds) + f" FROM compared GROUP BY {ids})"


# --- record normalization ------------------------------------------------------

#: Letters that decomposition leaves as they are.
_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "Æ": "AE", "Œ": "OE", "Ø": "O", "’": "''", "‘": "''"}


def base_norm(c: str) -> str:
    """Lower-case ASCII words; other letters lose their marks or become spaces."""
    for k, v in _LETTERS.items():
        c = f"replace({c}, '{k}', '{v}')"
    low = f"replace(lower(strip_accents({c})), '&', ' and ')"
    plain = rf"regexp_replace(regexp_replace({low}, '[''`´]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({plain}, '{lx.MISSING_WORDS}', ' ', 'g'), '\s+', ' ', 'g'))"


def phonetic_word(w: str) -> str:
    for a, b in lx.PHONETIC:
        w = f"replace({w}, '{a}', '{b}')"
    w = f"regexp_replace({w}, 'm([tdkgcjs])', 'n\\1', 'g')"
    w = f"substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '[aeiouy]', '', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        w = f"regexp_replace({w}, '{c}{c}+', '{c}', 'g')"
    return w


def state_codes(c: str) -> str:
    for n in sorted({len(k.split()) for k in lx.STATES}, reverse=True):
        names = sorted((k for k in lx.STATES if len(k.split()) == n), key=len, reverse=True)
        if n > 1:
            for k in names:
                c = rf"regexp_replace({c}, '\b{k}\b', '@{lx.STATES[k]}@', 'g')"
        else:
            c = map_words(c, {k: f"@{lx.STATES[k]}@" for k in names})
    return f"replace({c}, '@', '')"


def _fixed_digits(c: str) -> str:
    hit = "regexp_matches(w, '^[a-z015]*[015][a-z015]*$') AND length(regexp_replace(w, '[015]', '', 'g')) >= 3"
    return joined(f"list_transform({words(c)}, lambda w: CASE WHEN {hit} THEN translate(w, '015', 'ols') ELSE w END)")


def normalized(table: str, ids: str, name: str = "business_name", address: str = "business_address", country: str = "country") -> str:
    """CTEs ending in `norm`: ids and the thirteen derived columns."""
    web, indic = r"(?i)(?:www\.|https?://|\.(?:com|net|org|biz|info|in|fr|co)\b)", r"[\x{0900}-\x{0DFF}]"
    honorific = lx.HONORIFIC.removesuffix(r"(?=\S)")
    alias = lx.ALIAS
    return rf"""n0 AS (
        SELECT {ids}, {name} AS raw, regexp_matches({name}, '{web}') AS web, regexp_matches({name}, '{indic}') AS indic, {base_norm(country)} AS country_key, {base_norm(name)} AS n, {base_norm(address)} AS a FROM {table}
    ), n1 AS (
        SELECT * EXCLUDE (n), CASE WHEN web THEN trim(regexp_replace(n, '{lx.WEBSITE_ENDS}', '', 'g')) ELSE n END AS n FROM n0
    ), n2 AS (
        SELECT * EXCLUDE (n), regexp_replace({_fixed_digits("n")}, '{honorific}', '') AS n FROM n1
    ), n3 AS (
        SELECT *, {map_words("n", lx.NAME_WORDS)} AS name_n, regexp_replace(regexp_replace(regexp_replace(a, '\b(\d+)(?:st|nd|rd|th)\b', '\1', 'g'), '\b0+(\d)', '\1', 'g'), '\b(\d{{3}}) (\d{{3}})\b', '\1\2', 'g') AS tidy FROM n2
    ), n4 AS (
        SELECT *, {map_words("tidy", lx.ADDRESS_WORDS)} AS mapped, list_filter({words("name_n")}, lambda w: NOT list_contains({listed(lx.LEGAL)}, w)) AS kept, {words("name_n")} AS every FROM n3
    ), n5 AS (
        SELECT *, {state_codes("mapped")} AS addr_n, CASE WHEN len(kept) > 0 THEN kept ELSE every END AS core FROM n4
    ), n6 AS (
        SELECT *, regexp_extract_all(addr_n, '\b\d+\b') AS numbers FROM n5
    ), norm AS (
        SELECT {ids}, country_key, name_n, CASE WHEN regexp_matches(name_n, '{alias}') THEN trim(regexp_replace(name_n, '^.*?{alias}', '')) ELSE '' END AS name_alt, {joined("core")} AS name_core,
            CASE WHEN len(core) >= 2 THEN array_to_string(list_transform(core, lambda w: substr(w, 1, 1)), '') ELSE '' END AS acronym, {joined(f"list_transform(core, lambda w: {phonetic_word('w')})")} AS name_ph, addr_n,
            coalesce(list_last(list_filter(numbers, lambda x: length(x) BETWEEN 5 AND 6)), '') AS postal, coalesce(numbers[1], '') AS first_num, {joined("numbers")} AS nums, web::TINYINT AS is_web, indic::TINYINT AS is_indic FROM n6
    )"""
