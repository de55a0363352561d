"""Lexical rules: one bad and one good text each, places, views of equal length."""

import pytest

from codequarry.operators import lexical_rules

#: key, language, bad text, good text.
CASES = (
    ("S100", "javascript", "function do_it() { go(); }", "function doIt() { go(); }"),
    ("S100", "csharp", "public void run() { Go(); }", "public void Run() { Go(); }"),
    ("S100", "go", "func do_it() {\n\tx()\n}", "func doIt() {\n\tx()\n}"),
    ("S101", "typescript", "class my_thing {}", "class MyThing {}"),
    ("S106", "javascript", "console.log(1);", "// console.log(1)\nlog('console.log(1)');"),
    ("S106", "rust", 'println!("x");', 'info!("println!(1)");'),
    ("S107", "go", "func f(a, b, c, d, e, g, h, i int) {\n\tx()\n}", "func f(a, b int) {\n\tx()\n}"),
    ("S107", "rust", "fn f(a: A, b: B, c: C, d: D, e: E, f: F, g: G, h: H) { x() }", "fn f(a: A) { x() }"),
    ("S108", "javascript", "if (a) {\n}", "if (a) {\n // later\n}"),
    ("S108", "go", "for x {\n}", "for x {\n\ty()\n}"),
    ("S112", "csharp", 'throw new Exception("x");', 'throw new ArgumentException("x");'),
    ("S122", "javascript", "a(); b();", "for (i = 0; i < n; i++) { a(); }"),
    ("S125", "csharp", "// x = y;\nz();", "// a remark.\nz();"),
    ("S126", "rust", "if a { b() } else if c { d() }", "if a { b() } else if c { d() } else { e() }"),
    ("S131", "go", "switch x {\ncase 1:\n\ty()\n}", "switch x {\ncase 1:\n\ty()\ndefault:\n\tz()\n}"),
    ("S1067", "ruby", "x if a && b && c && d && e", "x if a && b"),
    ("S1110", "csharp", "x = ((a + b));", "x = ((a) + (b));"),
    ("S1116", "rust", "a();;\n", "a();\n"),
    ("S1125", "go", "if a == true {\n\tx()\n}", "if a {\n\tx()\n}"),
    ("S1186", "javascript", "function f() {}", "function f() { /* none */ }"),
    ("S1186", "csharp", "public void F() { }", "public override void F() { }"),
    ("S1264", "csharp", "for (; a < b; ) { c(); }", "for (;;) { c(); }"),
    ("S1301", "javascript", "switch (a) { case 1: b(); break; default: c(); }", "switch (a) { case 1: b(); case 2: c(); case 3: d(); }"),
    ("S1313", "javascript", 'connect("10.2.3.4");', 'connect("127.0.0.1");'),
    ("S1314", "go", "x := 0755", "x := 0o755 + 0"),
    ("S1479", "go", "switch x {\n" + "".join(f"case {i}: y()\n" for i in range(31)) + "}", "switch x {\ncase 1: y()\n}"),
    ("S1656", "rust", "x.a = x.a;", "let a = a;\nb = b.c;"),
    ("S1763", "javascript", "function f() {\n  a();\n  return 1;\n  b();\n}", "function f() {\n  if (a)\n    return 1;\n  b();\n}"),
    ("S1764", "ruby", "return a.b == a.b", "return a.b == a.c"),
    ("S1764", "javascript", "if (a === a) { b(); }", "x = c * a - a.b;"),
    ("S1862", "javascript", "if (a == 'x') { b(); } else if (a == 'x') { c(); }", "if (a == 'x') { b(); } else if (a == 'y') { c(); }"),
    ("S1871", "csharp", "if (a) { b(); } else if (c) { b(); }", 'if (a) { b("x"); } else if (c) { b("y"); }'),
    ("S1940", "go", "if !(a == b) {\n\tx()\n}", "if !(ok(a)) {\n\tx()\n}"),
    ("S2068", "csharp", 'var password = "hunter2";', 'var password = Read("x");'),
    ("S2092", "csharp", "c.Secure = false;", "c.Secure = true;"),
    ("S2208", "rust", "use a::b::*;", "use a::b::c;"),
    ("S2245", "javascript", "x = Math.random();", "x = 'Math.random()';"),
    ("S2612", "javascript", "fs.chmodSync(p, 0o777);", "fs.chmodSync(p, 0o750);"),
    ("S2737", "javascript", "try { a(); } catch (e) { throw e; }", "try { a(); } catch (e) { log(e); throw e; }"),
    ("S2757", "go", "x =+ 1", "x = +1\ny := -1"),
    ("S3330", "javascript", "o = { httpOnly: false };", "o = { httpOnly: true };"),
    ("S3923", "csharp", "if (a) { b(); } else { b(); }", "if (a) { b(); } else { c(); }"),
    ("S3981", "javascript", "if (a.length >= 0) { b(); }", "if (a.length > 0) { b(); }"),
    ("S4423", "csharp", "p = SslProtocols.Tls11;", "p = SslProtocols.Tls12;"),
    ("S4426", "javascript", "k = { modulusLength: 1024 };", "k = { modulusLength: 4096 };"),
    ("S4507", "csharp", "app.UseDeveloperExceptionPage();", "app.UseExceptionHandler();"),
    ("S4790", "javascript", "createHash('md5')", "createHash('sha256')"),
    ("S4830", "csharp", "h.ServerCertificateCustomValidationCallback = (a, b, c, d) => true;", "h.ServerCertificateCustomValidationCallback = Check;"),
    ("S5122", "javascript", "r.set('Access-Control-Allow-Origin', '*');", "r.set('Access-Control-Allow-Origin', o);"),
    ("S5332", "csharp", 'u = "http://site.org/x";', 'u = "https://site.org/x" + "http://localhost/";'),
    ("S5443", "javascript", "open('/tmp/x')", "open('/data/tmp/x')"),
    ("S5542", "csharp", "a.Mode = CipherMode.ECB;", "a.Mode = CipherMode.CBC;"),
    ("S5547", "javascript", "createCipheriv('des-cbc', k, i)", "createCipheriv('aes-256-gcm', k, i)"),
    ("S5659", "javascript", "verify(t, k, { algorithms: ['none'] })", "verify(t, k, { algorithms: ['RS256'] })"),
    ("S6418", "javascript", "const apiKey = 'abcdefghij0123456789xyz';", "const apiKey = env.KEY;"),
    ("S1134", "java", "int a; // FixMe later", "int a; // prefixmes\nString s = \"FIXME\";"),
    ("S1135", "java", "/* x\n * todo: y\n */", "// mytodo todo\n"),
    ("S2211", "java", "run((a, b, c) -> a);", "run((a, b) -> a); run((int a, int b, int c) -> a);"),
    ("S2211", "java", "run(a -> { go(); });", "switch (x) { case A -> { go(); } }"),
    ("S2143", "java", "import java.util.Date;\nclass A { Date d; }", "import java.util.Date;\nclass A { LocalDate d; } // Date"),
    ("S1134", "ruby", "x # fixme", "x # prefixme"),
    ("S1135", "ruby", "x # TODO: a", "x = 'TODO' # todos"),
    ("S126", "ruby", "if a\n  b\nelsif c\n  d\nend", "if a\n  b\nelsif c\n  d\nelse\n  e\nend"),
    ("S1309", "python", "import a  # noqa: F401", "import a  # noqaf\ns = '# noqa'"),
    ("S1309", "python", "run(x)  # why # NoSec B602", "run(x)  # nosec_x"),
    ("S1291", "javascript", "a(); // NOSONAR", "a(); // nosonar"),
    ("S1291", "typescript", "/* x\n NOSONAR */", "s = 'NOSONAR';"),
    ("G114", "go", "http.ListenAndServe(a, nil)", "srv.ListenAndServe(a, nil)"),
    ("G116", "go", 's := "\u202e"', 's := "x"'),
    ("G112", "go", "s := &http.Server{Addr: a}", "s := &http.Server{Addr: a, ReadHeaderTimeout: t}"),
    ("G124", "go", "c := http.Cookie{Secure: true}", "c := http.Cookie{Secure: true, HttpOnly: true, SameSite: http.SameSiteLaxMode}"),
    ("G301", "go", "os.MkdirAll(p, 0755)", "os.Mkdir(p, 0750)\nos.Mkdir(p, 0o700)"),
    ("G302", "go", "os.Chmod(p, 0640)", "os.Chmod(p, 0o600)\nos.Chmod(p, 0400)"),
    ("G303", "go", 'os.Create("/tmp/x")', 'os.Create("/data/tmp")'),
    ("G306", "go", "os.WriteFile(p, d, 0644)", "os.WriteFile(p, d, 0600)"),
    ("G307", "go", "os.Create(p)", "os.Open(p)"),
    ("G401", "go", 'import "crypto/md5"', 'import _ "crypto/sha1"'),
    ("G401", "go", 'import (\n\th "crypto/sha1"\n)', 'x := []string{"crypto/sha1"}'),
    ("G402", "go", "c := tls.Config{InsecureSkipVerify: true}", "c := tls.Config{InsecureSkipVerify: false}"),
    ("G403", "go", "rsa.GenerateKey(rand.Reader, 1024)", "rsa.GenerateKey(rand.Reader, 2048)"),
    ("G405", "go", 'import "crypto/rc4"', 'import "crypto/aes"'),
    ("G406", "go", 'import "golang.org/x/crypto/md4"', 'import "golang.org/x/crypto/sha3"'),
    ("SA1004", "go", "time.Sleep(100)", "time.Sleep(100 * time.Second)\ntime.Sleep(121)"),
    ("permissions-set-readonly-false", "rust", "p.set_readonly(false);", "p.set_readonly(true);"),
    ("no-async-promise-executor", "javascript", "new Promise(async (a, b) => { c(); })", "new Promise((a, b) => { c(); })"),
    ("CA2026", "csharp", "var e = JsonDocument.Parse(s).RootElement;", "var e = d.RootElement;"),
)
ODD = (None, "", "\n", '"open', "/* open", "'", "a\\", "`${x}`\n// é🙂\n'it\\'s' /[/]'/ \"\\\"\"", "r#\"a\"b\"# 'a 'b'", "=begin\nx\n=end\n# y")


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{kind}{i}", lang, text, 1) for i, (_, lang, bad, good) in enumerate(CASES) for kind, text in (("bad", bad), ("good", good))]
    rows += [(f"odd{lang}{i}", lang, t, 1) for lang in (*lexical_rules.LEXEMES, "java", None) for i, t in enumerate(ODD)]
    files = spark.createDataFrame(rows, "path string, language string, text string, rule_key int")
    return files, {(r.path, r.rule_key): r for r in lexical_rules.lexical_findings(files).collect()}


def test_bad_and_good(found):
    hits = found[1]
    wrong = [(i, *c[:2]) for i, c in enumerate(CASES) if (f"bad{i}", c[0]) not in hits or (f"good{i}", c[0]) in hits]
    assert not wrong


def test_places(found):
    r = found[1]["bad27", "S1763"]
    assert (r.sl, r.sc, r.el, r.ec) == (3, 2, 4, 3)
    r = found[1]["bad4", "S106"]
    assert (r.sl, r.sc, r.el, r.ec) == (1, 0, 1, 12)


def test_views_keep_lengths_and_breaks(found):
    for r in lexical_rules.views(found[0]).join(found[0].select("path", "text"), "path").collect():
        text = r.text or ""
        for view in (r.code, r.plain, r.solid, r.comments):
            assert len(view) == len(text) and [i for i, c in enumerate(view) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"], (r.path, view)


def test_keys_and_no_files(spark, found):
    assert {k for k, *_ in CASES} >= set(lexical_rules.rule_keys())
    assert lexical_rules.lexical_findings(found[0].limit(0)).count() == 0
    assert {k for _, k in found[1]} > {"S106"} == {r.rule_key for r in lexical_rules.lexical_findings(found[0], {"S106"}).select("rule_key").distinct().collect()}


QUALITY = (
    ("js/conditional-comment", "javascript", "/*@cc_on x @*/", "/* cc_on */"),
    ("js/shift-out-of-range", "javascript", "a = b << 32;", "a = b << 31;"),
    ("js/with-statement", "javascript", "with (a) { b(); }", "a.with(b);"),
    ("js/duplicate-parameter-name", "javascript", "function f(a, b, a) { g(); }", "function f(a, b, aa) { g(); }"),
    ("cs/call-to-gc", "csharp", "GC.Collect();", "// GC.Collect();"),
    ("cs/catch-nullreferenceexception", "csharp", "try { a(); } catch (NullReferenceException e) { b(); }", "try { a(); } catch (IOException e) { b(); }"),
    ("cs/class-implements-icloneable", "csharp", "class A : B, ICloneable { }", "class A : B { ICloneable c; }"),
    ("cs/empty-lock-statement", "csharp", "lock (a) { }", "lock (a) { b(); }"),
    ("cs/lock-this", "csharp", "lock (this) { b(); }", "lock (that) { b(); }"),
    ("cs/type-test-of-this", "csharp", "if (this is Circle) { a(); }", "if (that is Circle) { a(); }"),
    ("go/mistyped-exponentiation", "go", "x := 10 ^ 6", "x := a ^ 6"),
    ("go/negative-length-check", "go", "if len(x) < 0 { y() }", "if len(x) <= 0 { y() }"),
    ("go/shift-out-of-range", "go", "y := uint8(x) << 8", "y := uint16(x) << 8"),
    ("go/redundant-recover", "go", "defer recover()", "defer func() { recover() }()"),
    ("java/call-to-thread-run", "java", "new Thread(r).run();", "new Thread(r).start();"),
    ("java/comparison-with-nan", "java", "if (a == Double.NaN) b();", "if (Double.isNaN(a)) b();"),
    ("java/do-not-call-finalize", "java", "a.finalize();", "super.finalize();"),
    ("java/inefficient-boxed-constructor", "java", "a = new Integer(1);", "a = new IntegerBox(1);"),
    ("java/inefficient-empty-string-test", "java", 'if (s.equals("")) a();', 'if (s.equals("x")) a();'),
    ("java/inefficient-string-constructor", "java", 's = new String("a");', "s = new String(bytes);"),
    ("java/jdk-internal-api-access", "java", "import sun.misc.Unsafe;", "import java.misc.Safe;"),
    ("java/string-buffer-char-init", "java", "b = new StringBuilder('a');", 'b = new StringBuilder("a");'),
    ("java/suspicious-date-format", "java", 'f = new SimpleDateFormat("YYYY-MM-dd");', 'f = new SimpleDateFormat("yyyy-MM-dd");'),
    ("java/test-for-negative-container-size", "java", "if (a.size() >= 0) b();", "if (a.size() > 0) b();"),
    ("java/underscore-identifier", "java", "int _ = 1;", "int _a = 1;"),
    ("java/useless-tostring-call", "java", 's = "a".toString();', "s = a.toString();"),
    ("java/constants-only-interface", "java", "interface A { int B = 1; String C = x; }", "interface A { int B = 1; void c(); }"),
)


def test_quality_profile(spark):
    rows = [(f"{i}{kind}", language, text) for i, (_, language, bad, good) in enumerate(QUALITY) for kind, text in (("bad", bad), ("good", good))]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    found = {(r.path, r.rule_key) for r in lexical_rules.quality_findings(files).collect()}
    assert {(f"{i}bad", q[0]) for i, q in enumerate(QUALITY)} <= found
    assert not {(f"{i}good", q[0]) for i, q in enumerate(QUALITY)} & found
    assert {q[0] for q in QUALITY} == {r[0] for r in lexical_rules.QUALITY_RULES}
    assert not {r[0] for r in lexical_rules.QUALITY_RULES} & set(lexical_rules.rule_keys())
    with pytest.raises(ValueError):
        lexical_rules.quality_findings(files, {"js/none"})


def test_csharp_directives_are_no_code(spark):
    text = "#if DEBUG\nc.Secure = false;\n#else\n#region x; y; z;\nGo();\n#endif\n"
    found = lexical_rules.lexical_findings(spark.createDataFrame([("a", "csharp", text)], "path string, language string, text string")).collect()
    assert [(r.rule_key, r.sl) for r in found] == [("S2092", 2)]
