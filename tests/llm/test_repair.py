import hashlib
import itertools
import random
import re
import zlib

from stromlage.llm import repair as rp

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        match zlib.crc32(named.encode()) % 20:
            case 0:
                continue
            case 1:
                text = ""
            case 2:
                text = re.sub("[.!?]", "", text)
            case 3:
                out.append((conv, turn, role, text))
            case 4:
                role = "user"
        out.append((conv, turn, role, text))
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by a table over rows and roles given out; insertions until nothing gets cheaper."""
    legal = re.compile(r"s?(ua)*u?")
    best = {"": (0, "", [])}

    def better(table, initials, value):
        # Only how the roles given out end matters: nothing, s, u or a.
        key = initials[-1:]
        if legal.fullmatch(initials) and (key not in table or value[:2] < table[key][:2]):
            table[key] = value
            return True
        return False

    def inserted(table):
        while any([
            better(table, _given(key) + role[0], (c + 2, a + "I", out + [f"{role}:"]))
            for key, (c, a, out) in list(table.items()) for role in ("user", "assistant")
        ]):
            pass
        return table

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, found):
        after = {}
        for key, (c, a, out) in best.items():
            better(after, _given(key), (c + 3, a + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    better(after, _given(key) + role[0], (c + more, a + "K", out + [f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    better(after, _given(key) + new[0], (c + 2 + more, a + "R", out + [f"{new}:{text}"]))
        best = inserted(after)
    return min(v for k, v in best.items() if k in ("", "a"))


def _given(key):
    """Some legal initials that end so."""
    return {"": "", "s": "s", "u": "u", "a": "ua"}[key]


def brute(rows):
    convs, after = {r[0] for r in rows}, damaged(rows)
    out = {}
    for conv in convs:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        found = faults(own)
        cost, audit, repaired = cheapest(own, found)
        initials = [r[2][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, gone int")
    got = rp.repair(rp.damage(df)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    return {r.conv_id: r for r in got}


def test_given_table_same_as_brute_force(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(400):
        for _ in range(rng.randrange(1, 9)):
            rows.append((
                rng.choice([conv, conv, -conv]), rng.choice([None, *range(9)]),
                rng.choice(["user", "assistant", "system", "tool", "", None, "sys", "u"]),
                rng.choice(["Yes.", "No!", "and", "", None, "a. ", "?\n", " ", "x."]),
            ))
    check(spark, rows)


def test_long_conversations_are_taken_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b.", f"{t}.", f"{t}"])) for t in range(700)]
    rows += [(2, t, "tool", f"{t}.") for t in range(501)]
    rows += [(3, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(300)]
    check(spark, rows)
    for size in (1, 2, 3, 7):
        own = [rp.Row(r[2], r[3], f) for r, f in zip(rows[:60], faults(rows[:60]))]
        at = rp.Conversation(1)
        monkeypatch.setattr(rp, "BLOCK", size)
        for t, row in enumerate(own):
            at.add(t, *row)
        assert at.result()[6:8] == cheapest(rows[:60], faults(rows[:60]))[:2]


def test_no_rows_left_nulls_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = check(spark, [(gone, 0, "user", "A."), (None, None, None, None), (None, 1, "user", "Hi."), (7, 3, "assistant", "x" * 300000)])
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rp.repair(rp.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_turns_that_the_audits_leave(spark):
    df = rp.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    repairs = rp.repair(df)
    turns = {}
    for r in sorted(rp.repaired_turns(df, repairs).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repairs.collect():
        text = "\n".join(turns.get(r.conv_id, []))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in turns.get(r.conv_id, [])))
