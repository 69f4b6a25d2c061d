"""The manifest against a plain tree in Python, and versions that share what they don't copy."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskspark.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    n = row["n_chars"]
    return digest(*map(field, (row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"])))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """{(doc_id, leaf): sorted results} by the definition."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels_of([leaf(r) for r in groups[x]]) for x in langs]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for i, lang in enumerate(langs):
        for j, r in enumerate(groups[lang]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h, siblings = leaf(r, int(bad)), []
            for levels, at in ((trees[i], j), (top, i)):
                for level in levels[:-1]:
                    other = at ^ 1
                    near = [level[other]] if other < len(level) else []
                    siblings += near
                    h = digest(*(near + [h] if other < at else [h] + near))
                    at >>= 1
            out.append((str(r["doc_id"]), leaf(r), trees[i][-1][0], top[-1][0], digest(*siblings), h))
    return sorted(out)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def shown(found):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"])
                  for r in found.collect())


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_equals_the_plain_tree(frame, bits):
    langs = {i: ["en", "de", None, "Ünï", "zz"][i * i % 5] for i in range(75)}
    docs = frame([f"text {i}" if i % 9 else None for i in range(75)], langs=langs, sources={3: None})
    found = merkle.manifest(docs, tampered(), bits)
    assert shown(found) == plain([r.asDict() for r in docs.collect()])


def test_edge_rows(edges, nothing, all_null):
    for docs in (edges, nothing, all_null):
        assert shown(merkle.manifest(docs, tampered(), 2)) == plain([r.asDict() for r in docs.collect()])


def test_a_version_copies_its_path_and_shares_the_rest(frame):
    docs = frame([f"t{i}" for i in range(40)], langs={i: "en" if i % 3 else "de" for i in range(40)})
    rows = merkle.manifest(docs, F.col("doc_id") == 17, 2).collect()
    changed = [r for r in rows if r["copied"] is not None]
    assert [r["doc_id"] for r in changed] == [17]
    r = changed[0]
    original = merkle.copies(r["leaf"], r["shared"])  # the same path in the first version
    assert original[-1] == r["root"] != r["copied"][-1] == r["folded_root"]
    assert len(r["copied"]) == len(original) == len(r["shared"]) + 1
    assert not set(r["copied"]) & set(original)  # every ancestor is new
    assert all(x["folded_root"] == r["root"] for x in rows if x["doc_id"] != 17)


def test_block_is_the_whole_tree_of_its_leaves():
    leaves = [digest(str(i)) for i in range(11)]
    block = merkle.Block(leaves, merkle.height_of(11))
    assert block.levels == levels_of(leaves)
    for i in range(11):
        assert merkle.copies(leaves[i], block.path(i))[-1] == block.top
