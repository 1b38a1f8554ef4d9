"""Report and e-mail rendering."""

from pyspark.sql import functions as F

from reviewloom.operators.render import NO_THEMES, render_email, render_report

THEME = "struct<theme_name:string,theme_description:string,representative_quotes:array<string>,action_ideas:array<string>>"


def _df(spark, themes):
    return spark.createDataFrame([("App", "2026-W23", 4, themes)],
                                 f"product string, week string, lookback_weeks int, themes array<{THEME}>")


def test_empty_report(spark):
    r = render_report(_df(spark, []), "product", "week", "lookback_weeks", "themes", "2026-06-01").first()
    assert r.report_text.startswith("\n\n" + "=" * 80 + "\nApp — Weekly Review Pulse (2026-W23)\n")
    assert "Generated on: 2026-06-01 | Period: Last 4 weeks (rolling window)" in r.report_text
    assert NO_THEMES in r.report_text and r.report_text.endswith("-" * 80)


def test_themes_numbered_quotes_flattened(spark):
    th = [("Login", "Crashes at login.", ["line one\nline two"], ["Fix it"]),
          ("Speed", "Slow charts.", [], [])]
    r = render_report(_df(spark, th), "product", "week", "lookback_weeks", "themes", "2026-06-01").first()
    t = r.report_text
    assert "1. Login\nDescription: Crashes at login.\n\n* Real User Quotes:\n  - \"line one line two\"\n" in t
    assert "\n* Action Ideas:\n  - Fix it\n\n2. Speed\n" in t


def test_email_escapes_html(spark):
    th = [("<b>A&B</b>", "say \"hi\"", [], [])]
    df = _df(spark, th).withColumn("url", F.lit("https://docs.example.com/d/1?a=1&b=2"))
    e = render_email(df, "product", "week", "themes", "url").first()
    assert e.subject == "App Weekly Review Pulse — 2026-W23"
    assert "1. <b>A&B</b>\n   say \"hi\"\n\n" in e.email_text
    assert "&lt;b&gt;A&amp;B&lt;/b&gt;" in e.email_html and "say &quot;hi&quot;" in e.email_html
    assert 'href="https://docs.example.com/d/1?a=1&amp;b=2"' in e.email_html
