import random
import re

from tessella.llm.quotes import _turn_before, link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_quotes_link_to_what_they_quote(spark):
    rows = [
        (1, 0, "user", "First question here?\nWith a second line.\n\nAnother paragraph, alone."),
        (1, 1, "assistant", "An answer to it."),
        (1, 2, "user", "On Monday A wrote:\n> first question HERE?\n> with a second line.\n\nMy reply."),
        (1, 3, "assistant", "> Another paragraph alone\nThanks\n>> First question here\n> An answer to it."),
        (1, 4, "user", "> nobody said this\nReally?"),
        (1, 5, "user", "> An answer to it.\n> nobody said this either\nMixed"),
        (1, 7, "user", None), (2, 0, "user", "> An answer to it.\nOther conversation"), (2, 1, "user", ""), (2, 2, "user", "> > > deep\n>>> quote\n"),
        (3, 0, "user", "hello"), (3, 0, "user", "hello"), (3, 1, "user", "> hello\nyes"), (3, 1, "bot", "> hello\nno"), (None, 1, "user", "> hello\nx"), (4, None, "user", "y"),
        (5, 0, "user", "long " * 30_000), (5, 1, "user", "> " + "long " * 30_000 + "\n> ???\nshort"),
    ]
    got = link_quotes(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.body): (r.n_quotes, r.n_linked, r.reply_to, r.depth) for r in got}
    assert by[1, 0, rows[0][3]] == (0, 0, None, 0)
    assert by[1, 1, "An answer to it."] == (0, 0, 0, 1)
    assert by[1, 2, "My reply."] == (1, 1, 0, 1)
    assert by[1, 3, "Thanks"] == (3, 3, 0, 1)
    assert by[1, 4, "Really?"] == (1, 0, 3, 2)
    assert by[1, 5, "Mixed"] == (1, 1, 1, 2)
    assert by[1, 7, ""] == (0, 0, 5, 3)
    assert by[2, 0, "Other conversation"] == (1, 0, None, 0)
    assert by[2, 2, ""] == (1, 0, 1, 2)
    assert by[3, 1, "yes"] == by[3, 1, "no"] == (1, 1, 0, 1)
    assert by[None, 1, "x"] == (0, 0, None, 0)
    assert by[4, None, "y"] == (0, 0, None, 0)
    assert by[5, 1, "short"] == (1, 1, 0, 1)


def test_depths_follow_long_chains_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, i, "u", f"m{i}", "") for i in range(70)], SCHEMA)
    assert {r.turn: r.depth for r in link_quotes(docs).collect()} == {i: i for i in range(70)}
    assert link_quotes(docs.limit(0)).count() == 0


def plain(rows):
    """(conv, turn) -> (reply_to, depth, thread) of messages with one text a turn, by going through the conversation."""
    norm = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).strip()
    out = {}
    for conv in {r[0] for r in rows}:
        posted, before = {}, None
        for _, turn, _, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            lines = [(len(m.group(1).replace(" ", "")), m.group(2)) for m in (re.match(r"((?:[ \t]*>)*)[ \t]?(.*)", x) for x in text.split("\n"))]
            passages, own, last = [], [], 0
            for level, line in lines:
                if level == 0:
                    own.append(line)
                elif level != last:
                    passages.append([line])
                else:
                    passages[-1].append(line)
                last = level
            reply = None
            for part in passages:
                found = posted.get(norm("\n".join(part)))
                found = min((posted[norm(x)] for x in part if norm(x) in posted), default=None) if found is None else found
                reply = found if reply is None else reply
            reply = before if reply is None else reply
            out[conv, turn] = (reply, 0 if reply is None else out[conv, reply][1] + 1, turn if reply is None else out[conv, reply][2])
            body = "\n".join(own).strip()
            for unit in [body, *re.split(r"\n[ \t\r]*\n", body), *body.split("\n"), *re.split(r"(?<=[.!?])\s+", body)]:
                if norm(unit):
                    posted.setdefault(norm(unit), turn)
            before = turn
    return out


def test_replies_match_a_walk_through_each_conversation(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        said, turn = [], -3
        for _ in range(rng.randint(1, 40)):
            lines = [" ".join(rng.choices("red green blue sky sea".split(), k=rng.randint(1, 3))) + rng.choice([".", "!", "", ". Then more."]) for _ in range(rng.randint(0, 3))]
            if said and rng.random() < 0.6:
                lines[rng.randint(0, len(lines)) : 0] = [rng.choice(["> ", ">> "]) + rng.choice(said) for _ in range(rng.randint(1, 2))]
            rows.append((conv, turn, "u", "\n".join(lines)))
            said += [x for x in lines if x and not x.startswith(">")] or ["nothing"]
            turn += rng.choice([1, 1, 2, 3000])
    got = link_quotes(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.depth, r.thread) for r in got} == plain(rows)


def test_turn_before_spans_gaps_of_any_size(spark):
    turns = sorted({0, 1, 5, 1023, 1024, 1025, 5000, 2**21, 2**41, 2**41 + 1, 2**62, -7, -5000, -(2**45)})
    got = _turn_before(spark.createDataFrame([(c, t) for c in (1, 2) for t in turns[c - 1 :]], "conv long, turn long")).collect()
    for c in (1, 2):
        mine = turns[c - 1 :]
        assert {r.turn: r.before for r in got if r.conv == c} == dict(zip(mine, [None, *mine], strict=False))


def counted(rows):
    """(conv, turn) -> (body, passages, linked passages), by going through the conversation."""
    norm = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).strip()
    intro = re.compile(r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$")
    out = {}
    for conv in {r[0] for r in rows}:
        posted = set()
        for _, turn, _, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            lines = [(len(m.group(1).replace(" ", "").replace("\t", "")), m.group(2)) for m in (re.match(r"((?:[ \t]*>)*)[ \t]?(.*)", x) for x in text.split("\n"))]
            lines = [(level, line if level else raw) for (level, line), raw in zip(lines, text.split("\n"), strict=True)]
            passages = []
            for i, (level, line) in enumerate(lines):
                if level and i and lines[i - 1][0] == level:
                    passages[-1].append(line)
                elif level:
                    passages.append([line])
            own = [line for i, (level, line) in enumerate(lines) if level == 0 and not (i + 1 < len(lines) and lines[i + 1][0] > 0 and intro.match(line))]
            linked = sum(norm("\n".join(p)) in posted or any(norm(x) in posted for x in p if norm(x)) for p in passages)
            body = "\n".join(own).strip()
            out[conv, turn] = (body, len(passages), linked)
            posted |= {norm(u) for u in [body, *re.split(r"\n[ \t\r]*\n", body), *body.split("\n"), *re.split(r"(?<=[.!?])\s+", body)] if norm(u)}
    return out


def test_thousands_of_quotes_match_a_walk(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for conv in range(30):
        said = []
        for turn in range(80):
            lines = [" ".join(rng.choices(words, k=rng.randint(1, 6))) + rng.choice([".", "!", "", ", Ünd mehr?"]) for _ in range(rng.randint(0, 4))]
            for _ in range(rng.choice([0, 1, 2, 3]) if said else 0):
                level = rng.randint(1, 3)
                part = [rng.choice(said) if rng.random() < 0.7 else " ".join(rng.choices(words, k=4)) for _ in range(rng.randint(1, 3))]
                quote = [rng.choice(["> " * level, ">" * level + " ", " >" * level]) + rng.choice([x, x.upper(), x.replace(" ", "  ")]) for x in part]
                at = rng.randint(0, len(lines))
                lines[at:at] = rng.choice([[], ["On Friday Zoë wrote: "], ["not an introduction"]]) + quote
            rows.append((conv, turn, "u", "\n".join(lines)))
            said += [x for x in lines if x and not x.lstrip().startswith(">")][:2]
    got = link_quotes(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    want = counted(rows)
    assert {(r.conv_id, r.turn): (r.body, r.n_quotes, r.n_linked) for r in got} == want
    assert sum(w[1] for w in want.values()) > 3000 and sum(w[2] for w in want.values()) > 1500
