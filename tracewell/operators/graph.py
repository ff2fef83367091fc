"""Strongly connected components of small graphs, one graph a run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def components(nodes: Iterable[str], edges: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """The strongly connected components, each after every one that it reaches. Two passes, without recursion."""

    def finish_order(start: Iterable[str], out: Mapping[str, Iterable[str]], seen: set[str]) -> Iterable[list[str]]:
        for root in start:
            if root in seen:
                continue
            seen.add(root)
            done, stack = [], [(root, iter(sorted(set(out.get(root, ())))))]
            while stack:
                node, rest = stack[-1]
                following = next((x for x in rest if x not in seen), None)
                if following is None:
                    done.append(node)
                    stack.pop()
                else:
                    seen.add(following)
                    stack.append((following, iter(sorted(set(out.get(following, ()))))))
            yield done

    nodes = sorted(nodes)
    back: dict[str, list[str]] = {n: [] for n in nodes}
    for a in nodes:
        for b in edges.get(a, ()):
            back[b].append(a)
    order = [n for tree in finish_order(nodes, back, set()) for n in tree]
    return list(finish_order(reversed(order), edges, set()))
