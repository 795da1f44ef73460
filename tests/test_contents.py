"""Tables of contents: the window against a machine with a stack, and cases by hand."""

import random

import pytest

from folioflow.operators import contents


def rows(spark, *texts, kind="nav"):
    """(title, file, level, title of the parent) of the entries of each text."""
    books = spark.createDataFrame([(i, kind, t) for i, t in enumerate(texts)], "page_id long, kind string, contents string")
    out = [[] for _ in texts]
    found = contents.entries(contents.toc(books)).orderBy("page_id", "pos").collect()
    title = {(r.page_id, r.pos): r.title for r in found}
    for r in found:
        out[r.page_id].append((r.title, r.file, r.level, title.get((r.page_id, r.parent))))
    return out


def link(file, title=None, inner=""):
    return f'<li><a href="{file}">{title or file}</a>{inner}</li>'


def test_nesting_labels_and_duplicates(spark):
    nested = f"<ol>{link('x/a.html', 'A', '<ol>' + link('b.html#1', '<i>B</i>  1') + link('b.html#2', 'B2') + '</ol>')}{link('c.html', 'C')}</ol>"
    label = f"<ol>{link('pre.html')}<li><span>Part</span><ol>{link('one.html')}{link('two.html')}</ol></li>{link('end.html', 'End', '<ol>' + link('in.html') + '</ol>')}</ol>"
    same = f"<ol>{link('p.html', 'P', '<ol>' + link('p.html#c', 'C', '<ol>' + link('s.html', 'S') + '</ol>') + '</ol>')}</ol>"
    loose = f"</ol></ol><a href='out.html'>Out</a><OL class='x'>{link('q.html')}</ol ><a HREF = 'r.html' id=1>R</A>"
    empty = '<ol><li><a href="#here">nothing</a></li><li><a href="n.html"><img/></a></li><li><a>no</a></li></ol>'
    assert rows(spark, nested, label, same, loose, empty, None, "") == [
        [("A", "a.html", 1, None), ("B 1", "b.html", 2, "A"), ("C", "c.html", 1, None)],
        [("pre.html", "pre.html", 1, None), ("one.html", "one.html", 2, None), ("two.html", "two.html", 2, None), ("End", "end.html", 1, None), ("in.html", "in.html", 2, "End")],
        [("P", "p.html", 1, None), ("S", "s.html", 3, "P")],
        [("Out", "out.html", 1, None), ("q.html", "q.html", 1, None), ("R", "r.html", 1, None)],
        [],
        [],
        [],
    ]


def test_navigation_points(spark):
    point = lambda title, src, inner="": f"<navPoint id='x'><navLabel><text xml:lang=\"zh\">{title}</text></navLabel><content src='{src}'/>{inner}</navPoint>"
    text = f"<navMap>{point('I &amp; II', 'a%20b.html#p', point('Ch', 'c&amp;d.html') + point('<b>Ch</b> 2', 'e.html'))}<NAVPOINT>{point('Under a label', 'f.html')}</NAVPOINT>{point('Last', 'g.html')}</navMap>"
    assert rows(spark, text, kind="ncx") == [[("I & II", "a b.html", 1, None), ("Ch", "c&d.html", 2, "I & II"), ("Ch 2", "e.html", 2, "I & II"), ("Under a label", "f.html", 2, None), ("Last", "g.html", 1, None)]]


def test_any_depth(spark):
    deep = "".join(f'<ol><li><a href="{n}">t{n}</a>' for n in range(30)) + "</li></ol>" * 25 + '<li><a href="back">back</a></li>'
    found = rows(spark, deep)[0]
    assert found[:30] == [(f"t{n}", str(n), n + 1, f"t{n - 1}" if n else None) for n in range(30)]
    assert found[30] == ("back", "back", 5, "t3")


def machine(tags):
    """The rule with a stack, over (kind, file)."""
    depth, stack, seen, out = 0, [], {}, []
    for pos, (kind, file) in enumerate(tags, 1):
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(depth - 1, 0)
            del stack[max(depth, 1) :]
        elif kind == "item":
            if 1 <= depth <= len(stack):
                stack[depth - 1] = None
        else:
            level = max(depth, 1)
            if file not in seen:
                seen[file] = pos
                out.append((pos, level, stack[level - 2] if 2 <= level <= len(stack) + 1 else None))
            stack += [None] * (level - len(stack))
            stack[level - 1] = seen[file]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_window_equals_machine(spark, seed):
    pick = random.Random(seed)
    written = {"open": "<ol>", "close": "</ol>", "item": "<li>"}
    lists = [[(pick.choice(["open", "open", "close", "item", "link", "link"]), f"f{pick.randint(0, 12)}") for _ in range(pick.randint(0, 60))] for _ in range(60)]
    books = spark.createDataFrame([(i, "nav", "".join(written.get(k) or f'<a href="{f}">t</a>' for k, f in tags)) for i, tags in enumerate(lists)], "page_id long, kind string, contents string")
    got = {}
    for r in contents.entries(contents.toc(books)).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.level, r.parent))
    for i, tags in enumerate(lists):
        assert sorted(got.get(i, [])) == machine(tags)
