import random

from hypothesis import given, settings
from hypothesis import strategies as st

from triviary.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text()), st.one_of(st.none(), st.text(), st.sampled_from([*chat.CONTROL, "\\", "\\<|end|>", "<|end|>\\"]))), max_size=6))
def test_format_is_reversible(turns):
    text, spans = chat.formatted(turns)
    assert chat.turns_of(text) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(text[a:z]) for a, z in spans] == [t or "" for r, t in turns if r == "assistant"]


def brute(nodes):
    """The best path of each tree by mean score."""
    by = {}
    for tree, node, parent, role, text, score in nodes:
        by.setdefault(tree, {})[node] = (parent, role, text, score)
    out = {}
    for tree, own in by.items():
        parents = {p for p, *_ in own.values()}
        best = None
        for leaf in own:
            if leaf in parents:
                continue
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][0]
            if at in own:
                continue
            mean = sum(own[x][3] or 0.0 for x in path) / len(path)
            if best is None or (-mean, leaf) < best[:2]:
                best = (-mean, leaf, path[::-1])
        if best:
            out[tree] = [(own[x][1], own[x][2]) for x in best[2]]
    return out


def test_trees(spark):
    rnd = random.Random(1)
    nodes = []
    for tree in range(8):
        for n in range(rnd.randint(1, 25)):
            nodes.append((tree, n, rnd.randrange(n) if n else None, rnd.choice(["user", "assistant"]), f"t{tree}.{n}", rnd.choice([None, 0.5, 1.0, 2.0])))
    nodes += [(50, n, n - 1 if n else None, "user", f"deep {n}", 1.0) for n in range(70)]
    nodes += [(60, 1, 2, "user", "cycle", 0.0), (60, 2, 1, "user", "cycle", 0.0), (70, 1, 99, "user", "orphan", 0.0), (None, 1, None, "user", "null tree", 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.paths(df).orderBy("tree", "depth").collect():
        got.setdefault(r.tree, []).append((r.role, r.text))
    assert got == brute(nodes)
    one = {r.tree: r for r in chat.conversations(chat.paths(df)).collect()}
    assert chat.turns_of(one[50].formatted) == [("user", f"deep {n}") for n in range(70)]
    assert chat.conversations(chat.paths(df.limit(0))).count() == 0


def test_rows_in_order(spark):
    rows = [(1, 2, "assistant", None, 0), (1, 1, "user", "a", 0), (1, 2, "assistant", None, 0), (2, 5, None, "</s>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path int")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.conversations(chat.paths(chat.chain(df, "conv_id", ["turn"], "role", "text")))).collect()}
    assert got == {1: (3, 0), 2: (1, 0)}
