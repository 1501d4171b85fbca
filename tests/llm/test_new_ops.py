"""Spelling variants, repaired conversations and chat texts: against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from grainfield.llm import chat_format, chat_repair, permuterm
from grainfield.llm.queries import QUERIES


def plain_words(rows, damage, shortest=6, least=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words, ratio=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def forms(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_words_with_damage(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "Ünter unter UNTER ÄÖß÷ 日本語 straße"), (5, None), (6, ""), (7, "q" * 300 + " " + "Zz" * 100), (7, "q" * 300), (8, "퟿ a b\x00c")] * 3
    for damage, shortest, least in ((199, 6, 5), (3, 1, 1), (0, 2, 2)):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _id int, n string").repartition(3)
        found = permuterm.count_words(df, damage=damage, shortest=shortest, least=least).collect()
        want = plain_words(rows, damage, max(shortest, 1), least)
        assert {r.word: r.n for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("long", [permuterm.LONG, 5])
def test_forms_against_all_pairs(spark, long):
    """Random words over few letters, so that runs, chains, ties and words one edit apart in several ways are frequent; also with hashed turns."""
    random.seed(7)
    words = {"".join(random.choice("abü") for _ in range(random.randint(1, 9))): random.choice([1, 5, 5, 25, 125, 700]) for _ in range(700)}
    words |= {"a" * 80: 5, "a" * 81: 25, "a" * 40 + "b" + "a" * 40: 25, "c" + "a" * 80: 125, "z" * 3000: 5, "z" * 2999 + "y": 5, "d" * 64: 5, "d" * 65: 30, "d" * 30 + "e" + "d" * 34: 700, "d" * 63: 1}
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, key int").repartition(3)
    found = forms(permuterm.spelling_forms(df, longest=long))
    assert set(found) == plain_forms(words) and len(found) == len(words)


def test_forms_of_odd_tables(spark, sf):
    df = spark.createDataFrame([(None, 5), ("", 3), ("x", 1)], "word string, n long")
    assert set(forms(permuterm.spelling_forms(df))) == {("", None, "", 3, 1, None), ("x", None, "x", 1, 1, None)}
    assert forms(permuterm.spelling_forms(df.limit(0))) == []
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert permuterm.count_words(docs, damage=199).collect() == []


def test_op13(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = forms(QUERIES["op13_variants"](spark, sf))
    assert set(found) == plain_forms(plain_words(rows, 199)) and len(set(found)) == len(found)


def told(rows):
    """Conversations of (conv, turn, role, text) rows, each in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}


def plain_chat(rows, template=chat_format.Template()):
    out = set()
    for conv, turns in told(rows).items():
        learnt = [t for r, t in turns if r in template.learnt]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len("".join(learnt)), sha("".join(learnt))))
    return out


def digests(df):
    return [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()]


CHAT = "conv_id long, turn long, role string, text string, conv int, piece int, mask string"
ODD_CHAT = [
    (1, None, "user", "</s>"), (1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "tool</s>[/ROLE]", "<s>[INST]"), (2, 1, "assistant", ""), (None, 3, "assistant", "<\\s><\\\\s>[\\INST] \\"), (None, 1, "", "x\n[ROLE"),
    (3, 0, "assistant", "ü" * 300000 + "[INST"), (3, 1, "assistant", "日本\U0001f600<</s>>[[/INST]]"), (4, 0, "user", "s>"),
]


def test_chat_escapes():
    """Whatever a text holds, no control string is left in it and it reads back; a template may have its own marks."""
    for template in (chat_format.Template(), chat_format.Template({"user": "<|u|>"}, ("<|r|>", "<|/r|>"), "<|e|>", ("user",), ("<|u|>", "<|r|>", "<|/r|>", "<|e|>"))):
        random.seed(4)
        bits = [*template.controls, *[c[0] + "\\" + c[1:] for c in template.controls], *"<[\\/s>]", "SYS", "ü", "<<"]
        texts = ["".join(random.choices(bits, k=random.randint(0, 9))) for _ in range(3000)]
        shown = chat_format._escaped(pa.array(texts), template).to_pylist()
        assert [chat_format.unescaped(s, template) for s in shown] == texts
        assert not any(c in s for s in shown for c in template.controls)
        roles = [random.choice([*template.begins, "tool", "", template.controls[0]]) for _ in texts]
        whole = chat_format.assemble(pa.array(roles), pa.array(texts), template)[0].to_pybytes().decode()
        assert list(chat_format.read_turns(whole, template)) == list(zip(roles, texts))
    with pytest.raises(ValueError):
        chat_format.Template(controls=("<<s>",))
    with pytest.raises(ValueError):
        list(chat_format.read_turns("<s>[INST]a</s>b", chat_format.Template()))


def test_chat(spark, sf):
    for rows, n in ((ODD_CHAT, 3), ([], 1), ([(i, t, random.choice(["user", "assistant", None]), f"{t}") for i in range(3) for t in range(40)], 5)):
        df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CHAT).repartition(n)
        pieces = chat_format.format_chat(df)
        found = digests(chat_format.chat_digests(pieces))
        assert set(found) == plain_chat(rows) and len(found) == len(told(rows))
    text = {r.conv_id: r.formatted for r in chat_format.format_chat(spark.createDataFrame([(*r, 1, 2, "x") for r in ODD_CHAT], CHAT)).collect()}
    assert text[2] == "<s>[ROLE]tool<\\/s>[\\/ROLE][/ROLE]<\\s>[\\INST]</s><s>[/INST]</s>" and text[4] == "<s>[INST]s></s>"


def test_chat_in_pieces(spark):
    """A conversation over several batches is several pieces and one digest."""
    rows = [(i, t, ["user", "assistant"][t % 2], f"text {t} </s>") for i in (1, 2, None) for t in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pieces = chat_format.format_chat(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CHAT).repartition(4))
        assert pieces.where("conv_id = 1").count() > 5 and pieces.groupBy("conv_id", "piece").count().where("count > 1").isEmpty()
        assert set(digests(chat_format.chat_digests(pieces))) == plain_chat(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op12(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = digests(QUERIES["op12_chat"](spark, sf))
    assert set(found) == plain_chat(rows + [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]) and len(found) == len(told(rows)) + 1


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            yield from [row] * (2 if h == 3 else 1)


def plain_repair(turns):
    """All states, whole strings: cost, audit and repaired rows of the cheapest, least edits of [(role, text)] rows."""
    ways = {"": (0, "", [])}  # shape of what stands so far: '', s, u, a
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted(ways):
        for _ in range(4):
            found = dict(ways)
            for state, (cost, audit, out) in ways.items():
                for c in follow[state]:
                    if c in names:
                        better(found, c, (cost + 5, audit + "I", [*out, (names[c], "")]))
            ways = found
        return ways

    faults, seen = [], set()
    for role, text in turns:
        end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[0] not in ".!?" else None)
        seen.add((role, text))
    ways = inserted(ways)
    for (role, text), fault in zip(turns, faults):
        found, burden = {}, 5 * (fault == "truncated")
        for state, (cost, audit, out) in ways.items():
            better(found, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                for c in follow[state]:
                    if role[:1] == c:
                        better(found, c, (cost + burden, audit + "K", [*out, (role, text)]))
                    if c in names:
                        better(found, c, (cost + burden + 1, audit + "R", [*out, (names[c], text)]))
        ways = inserted(found)
    return faults, min(w for s, w in ways.items() if s in ("", "a"))


def plain_report(rows, every):
    found = {c: [] for c in every}
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role, text))
    for conv, turns in found.items():
        turns.sort()
        faults, (cost, audit, out) = plain_repair([t[2:] for t in turns])
        real = {t[1] for t in turns if t[0]}
        gaps = max(real) - min(real) + 1 - len(real) if real else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def reports(df):
    return [(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()]


def test_repair(spark):
    """Random conversations of few roles and texts, so that ties, repeats, gaps and impossible orders are frequent."""
    random.seed(5)
    texts, roles = ["Ja.", "Nein!", "abc", "", " \n", "Was?", "x. ", " ", None], ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    rows = [(i, random.choice([None, *range(8)]), random.choice(roles[: 3 + i % 7]), random.choice(texts[: 1 + i % 9])) for i in range(400) for _ in range(random.randint(0, 12))]
    rows += [(None, 3, "assistant", "Gut."), (None, 1, "user", "So?"), *[(-1, t, "user", f"{t}.") for t in range(300)], *[(-2, 0, "system", "Sei nett.")] * 50, (-3, 1 << 60, "user", "a."), (-3, None, "user", "b.")]
    nothing = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    for given, spread in ((rows, 4), ([], 1)):
        df = spark.createDataFrame([(*r, 1, 2, "x") for r in given], CHAT.replace("mask", "edit")).repartition(spread)
        found = reports(chat_repair.repair_digests(chat_repair.repair_conversations(df)))
        want = set(plain_report(nothing if given else [], {r[0] for r in given}))
        assert set(found) == want and len(found) == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # conversations over several batches
    try:
        found = reports(chat_repair.repair_digests(chat_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == set(plain_report(nothing, {r[0] for r in rows}))


def test_repair_lets_go():
    """What all survivors share is given out while the conversation goes on."""
    random.seed(6)
    for next_role, fault in ((lambda i: "ua"[i % 2], None), (lambda i: random.choice("uas"), None), (lambda i: "ua"[i % 2] if i % 7 else "s", "truncated"), (lambda i: "u", "blank")):
        search, out, most = chat_repair.Repair(), 0, 0
        for i in range(5000):
            out += sum(row is not None for _, row, _ in search.add((i,), next_role(i), fault))
            most = max(most, i + 1 - out)
        assert most < 100 and out + sum(row is not None for _, row, _ in search.end()) == 5000


def test_op11(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = reports(QUERIES["op11_repair"](spark, sf))
    assert set(found) == set(plain_report(plain_damage(rows), {r[0] for r in rows})) and len(found) == len({r[0] for r in rows})


def test_op11_odd_tables(spark, tmp_path):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3, 4, 5) for t in (None, 0, 1, 1, 2, 9) for r, x in (("user", "a.?"), (None, None))] + [(i, 0, "user", "x.") for i in range(100, 300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    found = reports(QUERIES["op11_repair"](spark, f"{tmp_path}/a"))
    assert set(found) == set(plain_report(plain_damage(rows), {r[0] for r in rows})) and len(found) == len(set(found))
    assert reports(QUERIES["op11_repair"](spark, f"{tmp_path}/b")) == []
    assert len(QUERIES["op12_chat"](spark, f"{tmp_path}/b").collect()) == 1
