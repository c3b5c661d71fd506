import io
import zipfile

from sparkloom.sources import decks, workspace

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def para(x):
    return f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"


def shape(*lines, kind=None):
    holder = f'<p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>' if kind else ""
    return f"<p:sp>{holder}<p:txBody>{''.join(map(para, lines))}</p:txBody></p:sp>"


def table(rows):
    cells = lambda r: "".join(f"<a:tc><a:txBody>{para(c)}</a:txBody></a:tc>" for c in r)
    return f"<p:graphicFrame><a:tbl>{''.join(f'<a:tr>{cells(r)}</a:tr>' for r in rows)}</a:tbl></p:graphicFrame>"


def rels(*targets):
    return "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{k}" Target="{t}"/>' for i, k, t in targets) + "</Relationships>"


def deck(path, slides, media, order=None):
    """``slides``: (body, pictures) in the order of file names; ``order``: their places in the presentation."""
    order = order or range(len(slides))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:presentation {NS}><p:sldIdLst>{''.join(f'<p:sldId id=\"{300 + k}\" r:id=\"rId{k}\"/>' for k in order)}</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", rels(*((f"rId{k}", "slide", f"slides/slide{k + 1}.xml") for k in range(len(slides)))))
        for k, (body, own) in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {NS}>{body}</p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", rels(("rId0", "slideLayout", "../slideLayouts/l.xml"), *((f"rId{i}", "image", f"../media/{n}") for i, n in enumerate(own, 1))))
        for n, c in media.items():
            z.writestr(f"ppt/media/{n}", c)
    path.write_bytes(b.getvalue())


def big(k, n=12_000):
    return bytes([k]) * n


def records(spark, path, **caps):
    return decks.slide_records(decks.deck_parts(workspace.scan(spark, str(path))), **caps).orderBy("path", "slide_no").collect()


def test_slides_come_in_presentation_order_with_groups_tables_and_pictures(spark, tmp_path):
    first = shape("Topic: Plan of work", kind="title") + f"<p:grpSp><p:grpSp>{shape('**inside**  a group', 'inside a group', 'Plan of work')}</p:grpSp></p:grpSp>" + table([["k", "", "v"], ["", "", ""], ["x", "", "y z"]]) + table([["alone"]])
    deck(tmp_path / "talk.pptx", [(shape("second") + "<p:pic/><p:pic/>", ["a.png"]), (first, []), ("", [])], {"a.png": big(1)}, order=[1, 2, 0])
    (tmp_path / "broken.pptx").write_bytes(b"no zip")
    one, last = records(spark, tmp_path)
    assert (one.slide_no, one.title, one.lines, one.tables, one.images) == (1, "Plan of work", ["inside a group"], [[["k", "v"], ["x", "y z"]]], [])
    assert (last.slide_no, last.title, last.lines, [i.name for i in last.images], last.images[0].mime) == (3, "", ["second"], ["talk - Slide 3 - Figure 1.png"], "image/png")
    text = {r.path.rsplit("/", 1)[1]: r.text for r in workspace.texts(workspace.scan(spark, str(tmp_path))).collect()}
    assert text["talk.pptx"].split("\n")[:3] == ["[Slide 1]", "Title: Topic: Plan of work", "**inside**  a group"] and text["talk.pptx"].endswith("[Slide 3]\nsecond\nVisual elements present: 2")


def test_pictures_are_capped_and_distinct(spark, tmp_path):
    media = {"a.png": big(1), "b.PNG": big(1), "c.jpg": big(2), "small.png": big(3, 11_999), "d.gif": big(4), "e.webp": big(5), "f.jpeg": big(6), "g.png": big(7)}
    deck(tmp_path / "x.pptx", [("", ["a.png", "b.PNG", "small.png", "d.gif", "c.jpg", "e.webp", "f.jpeg"]), ("", ["a.png", "g.png"]), ("", ["g.png"])], media)
    names = lambda **caps: [[i.name.split(" - ", 1)[1] for i in r.images] for r in records(spark, tmp_path, **caps)]
    assert names() == [["Slide 1 - Figure 1.png", "Slide 1 - Figure 2.jpg", "Slide 1 - Figure 3.webp"], ["Slide 2 - Figure 1.png", "Slide 2 - Figure 2.png"], ["Slide 3 - Figure 1.png"]]
    assert [len(x) for x in names(total=3)] == [3] and [len(x) for x in names(total=4)] == [3, 2]
    assert names(per_slide=1, assess=lambda c: c[0] != 1) == [["Slide 1 - Figure 1.jpg"], ["Slide 2 - Figure 1.png"], ["Slide 3 - Figure 1.png"]]


def test_both_bounds_of_bytes_and_one_cap(spark, tmp_path):
    deck(tmp_path / "a.pptx", [("", ["p.png"])], {"p.png": big(1)})
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    files = workspace.scan(spark, str(tmp_path))
    listed = [("i1.png", big(1)), ("i2", big(2, 8_000)), ("i3.jpg", big(3, 7_999)), ("i4.jpg", big(2, 8_000))]
    pages = lambda _: listed
    assert [(r.name, r.mime) for r in decks.workspace_images(files, page_images=pages).collect()] == [("a - Slide 1 - Figure 1.png", "image/png"), ("b - Visual 2.png", "image/png")]
    assert decks.workspace_images(files, most=1, page_images=pages).count() == 1 and decks.workspace_images(files).count() == 1


def test_a_workspace_without_decks(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    assert records(spark, tmp_path) == []
