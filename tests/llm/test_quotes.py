import hashlib
import re

import duckdb
import numpy as np
import pytest

from kinweave.llm import queries, quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def threads(seed, conversations=12, turns=14):
    """Conversations whose messages quote earlier ones, at several levels, with marks, case and blanks changed."""
    rng = np.random.default_rng(seed)
    phrases = [" ".join(f"w{rng.integers(0, 60)}" for _ in range(rng.integers(2, 7))) for _ in range(40)] + ["Thanks.", "I agree", "ñandú É!"]
    say = lambda: str(rng.choice(phrases))
    rows = []
    for c in range(conversations):
        conv, said = (None if c == 0 else c), []
        for t in range(turns):
            lines = [say() for _ in range(rng.integers(1, 4))]
            for _ in range(rng.integers(0, 3) if said else 0):
                source = str(rng.choice(said)).split("\n")
                lo = rng.integers(0, len(source))
                block = [(">" if rng.random() < 0.5 else "> ") + (x.upper() if rng.random() < 0.3 else x) for x in source[lo : lo + rng.integers(1, 4)]]
                if rng.random() < 0.3:
                    block = ["On Monday Ann wrote:", *block]
                at = rng.integers(0, len(lines) + 1)
                lines[at:at] = block
                if rng.random() < 0.4:
                    lines.insert(at + len(block), "")
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, None if rng.random() < 0.05 else int(t if rng.random() < 0.9 else max(0, t - 1)), str(rng.choice(["user", "assistant"])), text))
    return rows + [(3, 5, "user", None), (3, 5, None, ""), (3, 5, "user", None), (None, None, None, None), rows[5], rows[5], (77, 0, "a|b", "x"), (77, 0, "a", "b|x")]


def key(conv, turn, role, text):
    string = lambda s: "-" if s is None else f"{len(s)}:{s}"
    return hashlib.md5("|".join(["-" if conv is None else str(conv), "-" if turn is None else str(turn), string(role), string(text)]).encode()).hexdigest()


def brute_force(rows):
    """The same rules, message by message."""
    low = lambda x: re.sub(r"[^\w]|_", " ", x.lower())
    norm = lambda x: re.sub(" +", " ", low(x)).strip()
    turn_key = lambda t: (t is not None, t or 0)
    messages = {key(*r): r for r in set(rows)}
    passages = {}
    for k, (_, _, _, text) in messages.items():
        lines = (text or "").split("\n")
        marks = [re.match(r"(?:[ \t]{0,3}>)*", x)[0].count(">") for x in lines]
        if not any(marks):
            passages[k] = [(0, text or "")]
            continue
        levels = [-1 if m == 0 and re.match(r"(?i)^\s*on\b.*\bwrote\s*:\s*$", x) and i + 1 < len(lines) and marks[i + 1] else m for i, (m, x) in enumerate(zip(marks, lines))]
        runs = []
        for level, line in zip(levels, lines):
            line = re.sub(r"^((?:[ \t]{0,3}>)+)[ \t]?", "", line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        passages[k] = [(level, "\n".join(x)) for level, x in runs]

    def hashes(k, quoted):
        out = {}
        for level, passage in passages[k]:
            if level >= 0 and (level > 0) == quoted:
                for part in [passage, *passage.split("\n"), *re.split(r"\n[ \t]*\n", passage)]:
                    if norm(part):
                        out[norm(part)] = min(level, out.get(norm(part), level))
        return out

    said = {k: set(hashes(k, False)) for k in messages}
    reply, linked = {}, {}
    for k, (conv, turn, _, _) in messages.items():
        found = {}
        for phrase, level in hashes(k, True).items():
            before = [(turn_key(messages[o][1]), o) for o in messages if messages[o][0] == conv and phrase in said[o] and turn_key(messages[o][1]) < turn_key(turn)]
            if before:
                origin = max(before)[1]
                a, b = found.get(origin, (level, 0))
                found[origin] = (min(a, level), b + len(phrase))
        linked[k] = len(found)
        if found:
            reply[k] = min(found, key=lambda o: (found[o][0], -found[o][1], -(messages[o][1] or 0), o))
    out, places = {}, {}
    for k, (conv, turn, role, text) in messages.items():
        root, depth = k, 0
        while root in reply:
            root, depth = reply[root], depth + 1
        own = [x for level, x in passages[k] if level == 0]
        body = text if len(passages[k]) == 1 and passages[k][0][0] == 0 else re.sub(r"^\s+|\s+$", "", "\n".join(own))
        places.setdefault(conv, []).append((turn_key(messages[root][1]), root, turn_key(turn), k))
        out[k] = [conv, None, turn, role, body, messages[reply[k]][1] if k in reply else None, messages[root][1], depth, sum(level > 0 for level, _ in passages[k]), linked[k]]
    for listed in places.values():
        for i, (*_, k) in enumerate(sorted(listed)):
            out[k][1] = i + 1
    return sorted(map(tuple, out.values()), key=repr)


@pytest.mark.parametrize("seed,slice_rows", [(1, 1 << 20), (2, 3), (3, 40)])
def test_links_equal_brute_force(spark, seed, slice_rows):
    rows = threads(seed)
    out = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA), slice_rows)
    wanted = brute_force(rows)
    assert sum(r[9] for r in wanted) > 60 and max(r[7] for r in wanted) > 2
    assert sorted(map(tuple, out.collect()), key=repr) == wanted


def test_query_equals_its_sql_on_quoted_threads(spark, tmp_path):
    spark.createDataFrame(threads(4, 30, 20), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op4_quotation_links"])
    names = [c[0] for c in cur.description]
    wanted = sorted(cur.fetchall(), key=repr)
    out = queries.QUERIES["op4_quotation_links"](spark, str(tmp_path))
    assert sorted(out.columns) == sorted(names) and sum(r[names.index("n_linked")] for r in wanted) > 200
    assert sorted(map(tuple, out.select(names).collect()), key=repr) == wanted


def test_long_and_empty(spark):
    empty = quotes.link_quotes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, 0, "user", long), (1, 1, "user", f"> {long}\n\nyes")]
    out = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", position int, message string")).collect()}
    assert out[1]["reply_turn"] == 0 and out[1]["text"] == "yes" and out[1]["n_linked"] == 1
