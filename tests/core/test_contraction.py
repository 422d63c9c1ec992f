"""Components and blocks of graphs with hubs: what every round of them writes, and their results against plain versions."""

import random

from loomgraph.operators import components, cuts

EDGE = "source string, target string"


def plain_blocks(pairs):
    """Tree edges of each biconnected component by the least of its nodes but the uppermost, each component searched from its least node."""
    near, low, at, found = {}, {}, {}, {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for root in sorted(near):
        if root in at:
            continue
        at[root] = low[root] = len(at)
        stack, path = [(root, None, iter(near[root]))], []
        while stack:
            node, above, left = stack[-1]
            for other in left:
                if other not in at:
                    at[other] = low[other] = len(at)
                    path.append(other)
                    stack.append((other, node, iter(near[other])))
                    break
                if other != above:
                    low[node] = min(low[node], at[other])
            else:
                stack.pop()
                if above is not None:
                    low[above] = min(low[above], low[node])
                    if low[node] >= at[above]:
                        cut = path.index(node)
                        found[min(path[cut:])] = len(path) - cut
                        del path[cut:]
    return found


def test_blocks_of_random_graphs_with_paths_and_hanging_trees(spark):
    draw, pairs = random.Random(8), []
    for g in range(40):
        ids = [f"g{g:02}n{i:02}" for i in range(draw.randint(2, 30))]
        draw.shuffle(ids)
        pairs += [(ids[draw.randrange(i)], ids[i]) for i in range(1, len(ids))]  # a tree, and some edges more
        pairs += [(draw.choice(ids), draw.choice(ids)) for _ in range(draw.randint(0, len(ids) // 3))]
    ring = [f"ring{(37 * i) % 80:02}" for i in range(80)]
    pairs += list(zip(ring, ring[1:] + ring[:1])) + [(r, f"{r}leaf{i}") for r in ring for i in range(3)]  # a tour with leaves on it
    assert {r["block"]: r["edges"] for r in cuts.block_sizes(spark.createDataFrame(pairs, EDGE)).collect()} == plain_blocks(pairs)


def counted(monkeypatch, module):
    """Rows that each step of a module writes, by its name."""
    rows, kept = {}, module.checkpointed

    def checkpointed(df, name="step"):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "checkpointed", checkpointed)
    return rows


def test_leaves_of_a_forest_do_not_join_the_tour(spark, monkeypatch):
    rows = counted(monkeypatch, cuts)
    pairs = [(f"hub{i % 5}", f"leaf{i:03}") for i in range(500)] + [(f"hub{i}", "top") for i in range(5)]
    assert cuts.articulation_points(spark.createDataFrame(pairs, EDGE)).count() == 6
    assert sum(rows.get("tour", [])) < 100


def test_a_hub_takes_its_component_in_one_round(spark, monkeypatch):
    rows = counted(monkeypatch, components)
    pairs = [(f"hub{i % 5}", f"leaf{i:03}") for i in range(500)] + [(f"hub{i}", f"leaf{i * 7 + 1:03}") for i in range(5)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, EDGE)).collect()}
    assert len(found) == 505 and set(found.values()) == set(found[f"hub{i}"] for i in range(5))
    assert sum(n for name in ("edges", "rest") for n in rows.get(name, [])) < 2.2 * len(pairs)  # names and numbers of the edges once, and hardly any after a round
