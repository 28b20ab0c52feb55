import time

import pytest

from figmill.llm import markup as M

PLAIN = [None, "", "Data are mean ± s.d.; *p < 0.05, **p < 0.01, ***p < 0.001.", "Values a < b > c denote order.", "Particles <5 µm and >108 nm.", "Cost of R&D US$690, see US$450.", r"File C:\scans\plate3 and D:\x_1\item.",
         "Set {n = 5}; ~5 h.", "plate_6_row_B, [n = 198], scan #6.", "5'-ATG7-3' and 3'", "1. only one line", "* starred", "a = b == c", "x | y", "- 5 °C", "AT&T; R&D;", "(p<0.08, control > treated)"]
MARKED = {
    "<b>A</b> and <i>b": "A and b", "a &lt; b &amp; c&nbsp;d &#945;": "a < b & c d α", "<!-- x -->y": "y", "&lt;i&gt;x&lt;/i&gt; y": "x y", "# Head\ntext": "# Head\ntext", "Head\n====\ntext": "# Head\ntext",
    "**a** _b_ ~~c~~ `d_e_f`": "a b c d_e_f", "- a\n- b": "- a\n- b", "1. a\n2. b": "1. a\n2. b", "* a\n** b": "- a\n  - b", "> q": "> q", "[t](http://x/y)": "t", "![alt](a.png)": "alt", "[t][r]\n\n[r]: http://x": "t",
    "```py\nx = 1\n  y\n```\nz": "    x = 1\n      y\nz", "| a | b |\n|---|---|\n| 1 | 2 |": "a | b\n1 | 2", "''a'' '''b''' '''''c'''''": "a b c", "[[T|x]] [[y]]": "x y", "{{g|A|um}}": "A um", "== H ==\nt": "## H\nt",
    "{| class=w\n! a !! b\n|-\n| 1 || 2\n|}": "a | b\n1 | 2", "[https://x.y z w]": "z w", "<nowiki>''a''</nowiki>": "''a''", "__NOTOC__ a": "a", r"\textit{a} \emph{b} \textbf{c}": "a b c", r"{\it a} \& 5\%": "a & 5%",
    r"$\alpha = 1$ and $$x_2$$": r"$\alpha = 1$ and $x_2$", r"\(a/b\) \[c\]": "$a/b$ $c$", r"\begin{itemize}\item a \item b\end{itemize}": "- a\n- b", r"\section{S} t": "# S\nt", r"\begin{verbatim}a {b}\end{verbatim}": "    a {b}",
    "10<sup>3</sup> H<sub>2</sub>O": "10^3 H_2O", "<ul><li>a<li>b</ul>": "- a\n- b", "<table><tr><td>a</td><td>b</td></tr></table>": "a | b", "<pre><code>a &lt; b\nc</code></pre>": "    a < b\n    c",
    "<math>k_{5} = 2</math>": "$k_{5} = 2$", "<mml:math><mml:mi>y</mml:mi><mml:mo>=</mml:mo></mml:math>": "$y=$", "<IMG SRC='f' ALT='pic'> x": "pic x", "a<br/>b": "a\nb", "<strong>open": "open", "``q'' x": '"q" x',
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_stay(text):
    assert M.markup_kinds(text) == [] and M.clean(text) == text


@pytest.mark.parametrize("text,want", MARKED.items())
def test_markup_goes(text, want):
    assert M.markup_kinds(text) and M.clean(text) == want


def test_best_container_is_kept():
    page = "<html><body><div class=nav><a href=1>Home</a> <a href=2>About us</a></div><div><h1>T</h1><p>A long, long paragraph, with commas, that goes on and on so that it scores well.</p><p>More, here.</p></div><div><a href=3>imprint</a></div></body></html>"
    assert M.clean(page) == "# T\nA long, long paragraph, with commas, that goes on and on so that it scores well.\nMore, here."
    assert M.clean("<p>one</p><p>two <a href=x>link</a></p>") == "one\ntwo link"


def test_length_and_depth_are_not_limited():
    run = "word " * 120 + "end"
    for a, b in (("**", "**"), ("'''", "'''"), ("_", "_"), ("<b>", "</b>"), ("\\textbf{", "}")):
        assert M.clean(f"x {a}{run}{b} y") == f"x {run} y"
    deep = "<ul><li>" * 120 + "one<li>two"
    assert [x.lstrip() for x in M.clean(deep).split("\n") if x.strip("- ")] == ["- one", "- two"]
    assert M.clean("\\emph{" * 9 + "core" + "}" * 9 + " x") == "core x"
    assert M.clean("{{a|" * 9 + "core" + "}}" * 9) == "core"
    assert M.clean("```\na" + " " * 100 + "b\n```") == "    a" + " " * 100 + "b"


def test_found_by_the_tree():
    assert M.kinds_of(M.parse("a </b> c")) == ["html"] and M.clean("a </b> c") == "a c"
    assert M.kinds_of(M.parse("\\textbf{open")) == ["latex"] and M.clean("\\textbf{open") == "open"
    assert M.markup_kinds("== H ==\n[x](http://y) &alpha; $a$") == ["html", "markdown", "wiki", "latex"]
    assert M.clean("see <a href='x>y</a") and M.markup_kinds("<b unclosed") == ["html"]


def test_heading_in_a_container_of_its_own():
    text = "a long, long paragraph, with commas, that goes on and on so that it scores well"
    assert M.clean(f"<div><h2>Methods</h2></div><div><p>{text}</p></div>") == f"## Methods\n{text}"
    assert M.clean(f"<body><div><h1>T</h1></div><div><div><p>{text}</p></div><div><a href=1>imprint</a></div></div></body>") == f"# T\n{text}"


def test_hostile_texts():
    begin = time.time()
    for bad in ["*a " * 20_000 + "b* " * 20_000, "\\a{" * 50_000, "\\a{" * 20_000 + "}" * 20_000, "<ul><li>x" * 500, "- one\n" + "long line of words " * 50 + "\n" + ("word " * 60 + "\n") * 40, "\\[" * 50_000, "\\(" * 50_000, "# " + " " * 100_000 + "x",
                "&" * 50_000, "<div>" * 5000 + "x", "[a](" * 20_000, "**" * 50_000, "'' " * 50_000, "<pre>" * 20_000, "<a b " * 20_000]:
        M.clean(bad)
    assert time.time() - begin < 60

    for bad in ["<", "<a", "[[", "{{x", "```", "$$", "<b>" * 3000, "*" * 5000, "_a " * 2000, "<ul><li>" * 500, "x" * 200_000, "\\a{" * 1000, "{|\n|-\n" * 300, " " * 50_000 + "<b>"]:
        M.clean(bad)
    long = "word, " * 20_000 + "<i>end</i>"
    assert M.clean(long).endswith("end") and len(M.clean(long)) > 100_000


def test_operator(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<b>a</b>", "x"), (3, "<b>a</b>", "x"), (4, "plain", None)], "row_no long, caption string, clean string")
    got = sorted((r.row_no, r.clean or "", tuple(r.kinds)) for r in M.markup_to_text(df).collect())
    assert got == [(1, "", ()), (2, "", ()), (3, "a", ("html",)), (3, "a", ("html",)), (4, "plain", ())]
    assert M.markup_to_text(df).where("row_no = 1").first().clean is None
    assert M.markup_to_text(df.where("false")).count() == 0
