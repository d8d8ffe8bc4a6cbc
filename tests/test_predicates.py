"""Row predicates, including NULL and letter-case behaviour."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from traceprofile.functions import annotate
from traceprofile.functions import predicates as P


def _column(spark, names, column):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_framework_prefixes_ignore_case_and_need_the_start(spark):
    names = ["void android.view.View.draw()", "VOID ANDROID.x", "x void android.", "void androidx.A",
             "java.lang.String.trim()", "javaxlang.A", None, "kotlinx.coroutines.Job kotlin.X"]
    got = _column(spark, names, P.not_framework(F.col("n")))
    assert got == [False, False, True, True, False, True, None, False]


def test_io_keywords_case_sensitive_form(spark):
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits + " ._$"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    for word in P.IO_KEYWORDS:
        names += [word, f"pre{word}post", word.swapcase()]
    names.append(None)
    got = _column(spark, names, P.is_io_related(F.col("n")))
    assert got == [n is not None and any(k in n for k in P.IO_KEYWORDS) for n in names]


def test_io_keywords_diagnostic_form_ignores_case(spark):
    names = ["com.app.Profile.load", "BINDER", "HTTP", "quiet"]
    assert _column(spark, names, P.mentions_io(F.col("n"))) == [True, True, True, False]


def test_keyword_is_literal_text(spark):
    names = ["a.b", "axb", "A.B()"]
    assert _column(spark, names, P.contains_keyword(F.col("n"), "a.b")) == [True, False, True]


def test_main_thread_rules_with_missing_values(spark):
    rows = [
        (0, "main", 5, None, None), (1, "w", 7, None, 7), (2, "w", 7, 1, None),
        (3, None, 7, None, None), (4, "w", 7, 0, 8), (5, None, 7, 0, 7),
    ]
    df = spark.createDataFrame(rows, "i int, n string, tid long, flag int, pid long")
    cols = [F.col(c) for c in ("n", "tid", "flag", "pid")]

    def kept(rule):
        return {r.i for r in df.filter(P.is_main_thread(*cols, rule=rule)).collect()}

    assert kept("any") == {0, 1, 2, 5}
    assert kept("name_or_pid") == {0, 1, 5}
    assert kept("name_or_flag") == {0, 2}


def test_method_notes_take_the_most_specific_rule(spark):
    cases = {
        "com.a.Login$submit$1$2.invokeSuspend()": "← Kotlin lambda in Login.submit()",
        "com.a.Login$submit$1.invokeSuspend()": "← coroutine continuation of Login.submit()",
        "com.a.Login$session$2.invoke()": "← lazy init of Login.session",
        "com.a.Login$1.run()": "← anonymous Runnable in Login",
        "com.a.Foo.a3()": "← obfuscated method (ProGuard)",
        "com.a.Foo.F3": "← obfuscated method (ProGuard)",
        "msdocker.hook.Proxy.call()": "← DroidPlugin hook / string decryption",
        "a.Ill111l.get()": "← DroidPlugin hook / string decryption",
        "a.illi()": "← DroidPlugin hook / string decryption",
        "com.app.Main.start()": "",
    }
    assert _column(spark, list(cases), annotate.method_note(F.col("n"))) == list(cases.values())


def test_a_method_may_carry_several_cause_tags(spark):
    df = spark.createDataFrame(
        [("com.vivo.SQLiteFile.read()",), ("android.os.MessageQueue.next()",), ("calm()",)],
        "name string",
    )
    got = {(r.name, r.tag) for r in annotate.pattern_tags(df).collect()}
    assert got == {
        ("com.vivo.SQLiteFile.read()", "vendor_sdk"), ("com.vivo.SQLiteFile.read()", "io"),
        ("com.vivo.SQLiteFile.read()", "database"), ("android.os.MessageQueue.next()", "idle"),
    }
