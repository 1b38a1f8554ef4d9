"""Report and e-mail rendering (R1, R2) as string expressions, one row per
(product, week).  The themes array is bounded by the clusters of one week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import DEFAULT_TITLE
from ..functions.text import newline_to_space

# Report layout strings.
RULE = "=" * 80
DIVIDER = "-" * 80
THEMES_HEADER = "📋 TOP FEEDBACK THEMES:\n\n"
NO_THEMES = "No prominent feedback clusters were identified for this period.\n\n"


def _themes_block(themes: Column) -> Column:
    def one(t, i):
        quotes = F.array_join(F.transform(t["representative_quotes"],
                                          lambda q: F.concat(F.lit('  - "'), newline_to_space(q), F.lit('"\n'))), "")
        ideas = F.array_join(F.transform(F.coalesce(t["action_ideas"], F.array().cast("array<string>")),
                                         lambda a: F.concat(F.lit("  - "), a, F.lit("\n"))), "")
        return F.concat((i + 1).cast("string"), F.lit(". "), t["theme_name"], F.lit("\nDescription: "),
                        t["theme_description"], F.lit("\n\n* Real User Quotes:\n"), quotes,
                        F.lit("\n* Action Ideas:\n"), ideas, F.lit("\n"))
    return F.array_join(F.transform(themes, one), "")


def render_report(df: DataFrame, product_col: str, week_col: str, lookback_col: str, themes_col: str,
                  generated_on: str) -> DataFrame:
    """Plain-text report section.  ``generated_on`` (yyyy-MM-dd) is an
    argument so output is reproducible."""
    th = F.coalesce(F.col(themes_col), F.array())
    body = F.when(F.size(th) == 0, F.lit(NO_THEMES)).otherwise(_themes_block(th))
    text = F.concat(
        F.lit("\n\n" + RULE + "\n"), F.col(product_col), F.lit(" — " + DEFAULT_TITLE + " ("), F.col(week_col),
        F.lit(")\nGenerated on: " + generated_on + " | Period: Last "), F.col(lookback_col).cast("string"),
        F.lit(" weeks (rolling window)\n" + RULE + "\n\n" + THEMES_HEADER), body, F.lit(DIVIDER))
    return df.withColumn("report_text", text)


def _html_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def render_email(df: DataFrame, product_col: str, week_col: str, themes_col: str, url_col: str) -> DataFrame:
    """R2: subject, plain text and HTML teaser (HTML-escaped, a deliberate
    divergence from the unescaped original)."""
    th = F.coalesce(F.col(themes_col), F.array())
    items = F.array_join(F.transform(th, lambda t, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), t["theme_name"], F.lit("\n   "), t["theme_description"], F.lit("\n\n"))), "")
    text = F.concat(F.col(product_col), F.lit(" — " + DEFAULT_TITLE + " ("), F.col(week_col),
                    F.lit(")\n\nHere is a summary of customer feedback themes from the app store:\n\n"), items,
                    F.lit("Read the full detailed report, including verbatim user quotes and actionable ideas, "
                          "in the shared document:\n"), F.col(url_col),
                    F.lit("\n\n---\nThis pulse report was automatically generated and delivered."))
    li = F.array_join(F.transform(th, lambda t: F.concat(
        F.lit("<li><strong>"), _html_escape(t["theme_name"]), F.lit("</strong><br/><span>"),
        _html_escape(t["theme_description"]), F.lit("</span></li>"))), "")
    html = F.concat(F.lit("<div><h2>"), _html_escape(F.col(product_col)), F.lit(" — " + DEFAULT_TITLE + "</h2>"),
                    F.lit("<p>Period Focus: <strong>"), _html_escape(F.col(week_col)), F.lit("</strong></p><ul>"),
                    li, F.lit('</ul><a href="'), _html_escape(F.col(url_col)),
                    F.lit('">Read Full Document Report</a></div>'))
    return df.withColumn("subject", F.concat(F.col(product_col), F.lit(" " + DEFAULT_TITLE + " — "), F.col(week_col))) \
             .withColumn("email_text", text).withColumn("email_html", html)
