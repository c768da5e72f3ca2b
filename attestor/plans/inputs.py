"""Inputs derived from the given tables, as portable SQL that both engines run.

``{S}`` stands for the text type. Only integers, dates and texts are used, so both engines
derive the same values. Every order becomes an uploaded document; every event becomes a
reviewer's decision about the document its value points at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.session import read_spread

# <NBSP> stands for a no-break space, as PDF text has it inside numbers.
BUSINESS_DOCUMENTS = r"""
SELECT k AS doc_id, d AS received, ts AS received_at,
 CASE k%5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'certificate' WHEN 2 THEN 'contract' WHEN 3 THEN 'report' ELSE 'memo' END
 || '_' || CAST(k AS {S})
 || CASE WHEN k%29=0 THEN '.exe' WHEN k%31=0 THEN '.PDF' ELSE '.txt' END AS filename,
 CASE WHEN k%43=0 THEN NULL WHEN k%17=0 THEN 0 WHEN k%19=0 THEN 6291456 + k%999 WHEN k%23=0 THEN 5242880 ELSE 1000+k%5000 END AS size_bytes,
 CASE WHEN k%29=0 THEN 'application/x-msdownload' WHEN k%31=0 THEN 'application/pdf'
      WHEN k%37=0 THEN 'image/png' WHEN k%41=0 THEN NULL ELSE 'text/plain' END AS declared_mime,
 CASE WHEN k%47=0 THEN '  ' || chr(10) || ' ' ELSE
 CASE k%5
  WHEN 0 THEN 'TAX INVOICE' || chr(10) || 'Seller: Firm ' || CAST(c AS {S}) || ' Ltd' || chr(10)
   || CASE WHEN k%3<>0 THEN 'Invoice No: INV-' || CAST(k AS {S}) || chr(10) ELSE '' END
   || CASE WHEN k%4<>0 THEN 'Seller GSTIN: ' || lpad(CAST(k%37 AS {S}),2,'0') || 'AAAAA' || lpad(CAST(k%10000 AS {S}),4,'0') || 'A1Z5' || chr(10)
        || 'Seller PAN: ABCDE' || lpad(CAST(k%10000 AS {S}),4,'0') || 'F' || chr(10) ELSE '' END
   || CASE WHEN k%8<>0 THEN 'HSN: 85044090' || chr(10) ELSE '' END || 'Date: ' || d || chr(10)
   || 'Total Amount Due: INR ' || CAST(amt AS {S})
  WHEN 1 THEN 'CERTIFICATE OF REGISTRATION' || chr(10)
   || CASE WHEN k%3<>0 THEN 'FSSAI License: 100200420000' || lpad(CAST(k%100 AS {S}),2,'0') || chr(10) ELSE '' END
   || 'Valid From: ' || d || chr(10) || 'Valid Until: 2031-12-31' || chr(10)
   || 'Entity Name: Firm ' || CAST(c AS {S}) || chr(10) || 'Address: 12 Main Road'
   || CASE WHEN k%2=0 THEN chr(10) || 'Signature: Authorized Officer' ELSE '' END
  WHEN 2 THEN 'SERVICE AGREEMENT' || chr(10) || 'Effective Date: ' || d || chr(10)
   || 'Parties: Firm ' || CAST(c AS {S}) || ' Ltd' || chr(10) || 'Scope of work: delivery'
   || CASE WHEN k%3<>0 THEN chr(10) || 'Signed by Firm' ELSE '' END
   || CASE WHEN k%4<>0 THEN chr(10) || 'Dispute resolution: arbitration' ELSE '' END
  WHEN 3 THEN 'SUMMARY REPORT' || chr(10) || 'Date: ' || d
   || CASE WHEN k%4<>0 THEN chr(10) || 'Reporting Period: Q2' ELSE '' END || chr(10) || 'Signature: Director'
   || CASE WHEN k%3=0 THEN chr(10) || 'Issued by Firm Ltd under Ind AS' ELSE '' END
  ELSE 'Lunch plan for ' || d END
 || CASE WHEN k%6=0 THEN chr(10) || 'Contact: user' || CAST(c AS {S}) || '@mail.example.com' ELSE '' END
 || CASE WHEN k%7=0 THEN chr(10) || CASE WHEN k%2=0 THEN 'Phone: +91-98765' ELSE 'Phone: +91<NBSP>98765' END || lpad(CAST(k%100000 AS {S}),5,'0') ELSE '' END
 || CASE WHEN k%9=0 THEN chr(10) || 'Card: 4111 1111 1111 1111' WHEN k%13=0 THEN chr(10) || 'Ref: 1234-5678-9012-3456' ELSE '' END
 || CASE WHEN k%11=0 THEN chr(10) || CASE WHEN k%2=0 THEN 'Aadhaar: 1234 5678 9012' ELSE 'Aadhaar: 1234<NBSP>5678<NBSP>9012' END ELSE '' END
 END AS text
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS ts, CAST(CAST(o_orderdate AS DATE) AS {S}) AS d,
             CAST(floor(o_totalprice) AS BIGINT) AS amt FROM orders) b
""".replace("<NBSP>", "\u00a0")

# An event reviews the document whose number its value spells in cents; many documents get
# several reviews, many reviews point at no pending document.
REVIEWS = r"""
SELECT md5(CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS {S})) AS session_id,
 ts AS review_ts, event_id AS review_no,
 CASE event_type WHEN 'purchase' THEN 'COMPLIANT' WHEN 'signup' THEN 'non_compliant'
                 WHEN 'error' THEN 'INVALID' WHEN 'click' THEN '' ELSE NULL END AS override_status,
 CASE WHEN user_id%3=0 THEN 'checked by user ' || CAST(user_id AS {S}) WHEN user_id%3=1 THEN '' ELSE NULL END AS reviewer_notes
FROM events
"""

# Model answers about an order: fenced JSON, JSON in prose, broken JSON, nothing, or JSON
# with trailing content; some authors speak twice.
AGENT_EVENTS = r"""
SELECT doc_id, seq, author, text, is_final FROM (
 SELECT k AS doc_id, 1 AS seq, 'TriageAgent' AS author,
  CASE k%5 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'The answer is ' || j || ' as asked.'
           WHEN 2 THEN '{{"doc_type": ' WHEN 3 THEN '' ELSE j END AS text, FALSE AS is_final FROM t
 UNION ALL
 SELECT k, 2, 'TriageAgent', CASE WHEN k%7=0 THEN '{{"doc_type":"contract","confidence":0.5}}' ELSE '' END, FALSE FROM t
 UNION ALL
 SELECT k, 3, 'AuditorAgent',
  CASE k%4 WHEN 0 THEN a WHEN 1 THEN '```' || chr(10) || a || chr(10) || '```' WHEN 2 THEN '  ' || a || ' ' || a ELSE 'no json here' END, FALSE FROM t
 UNION ALL
 SELECT k, 4, 'ReporterAgent', '## Report on order ' || CAST(k AS {S}), TRUE FROM t
 UNION ALL
 SELECT k, 5, 'ReporterAgent', CASE WHEN k%11=0 THEN '' ELSE NULL END, k%11<2 FROM t
) e
"""

AGENT_EVENTS_BASE = r"""
SELECT o_orderkey AS k,
 '{{"doc_type":"' || CASE o_orderkey%3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'report' ELSE '' END || '","confidence":0.75,"reasoning":"cue words"}}' AS j,
 '{{"status":"' || CASE WHEN o_orderkey%6=0 THEN '' ELSE 'NON_COMPLIANT' END || '","severity":"HIGH","compliance_score":'
  || CASE WHEN o_orderkey%5=0 THEN '"' || CAST(o_orderkey%101 AS {S}) || '"' ELSE CAST(o_orderkey%101 AS {S}) END
  || ',"violations":[' || CASE WHEN o_orderkey%3=0 THEN '' ELSE '"INV-01: no tax id","order ' || CAST(o_orderkey AS {S}) || ' unclear"' END
  || '],"recommendations":["ask the seller"]}}' AS a
FROM orders
"""

# The answers of the structured second try: one row per document that got one.
FALLBACKS = r"""
SELECT o_orderkey AS doc_id,
 CASE o_orderkey%4 WHEN 0 THEN 'certificate' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'report' END AS doc_type,
 CASE WHEN o_orderstatus='F' THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' ELSE '' END AS severity,
 CAST(o_custkey%101 AS INT) AS compliance_score,
 CASE WHEN o_orderstatus='F' THEN '' ELSE 'GEN-03: no issuer' END AS violation,
 'add the issuer' AS recommendation
FROM orders WHERE o_orderstatus <> 'P'
"""

# Violation texts in their three forms: labelled, unlabelled, and over two lines.
VIOLATIONS = r"""
SELECT l_orderkey AS doc_id, l_linenumber AS line_no,
 CASE l_returnflag
  WHEN 'A' THEN CASE l_linenumber%4 WHEN 0 THEN 'INV-01' WHEN 1 THEN 'CERT-03' WHEN 2 THEN 'GEN-04' ELSE 'XYZ-99' END || ': line ' || CAST(l_linenumber AS {S}) || ' of part ' || CAST(l_partkey AS {S})
  WHEN 'N' THEN 'part ' || CAST(l_partkey AS {S}) || ' lacks papers'
  ELSE 'INV-02: first line' || chr(10) || 'second line ' || CAST(l_partkey AS {S}) END AS violation
FROM lineitem
"""

# Report prose with Markdown marks and characters outside Latin-1.
MARKDOWN = r"""
SELECT doc_id, '## Heading ' || CAST(doc_id AS {S}) || chr(10) || '**bold** and *italic* `code` “quoted” ‘it’ – — • ✅ ❌ ⚠ 🚨 ✔ 漢字 ' || chr(10) || text || '  ' AS text
FROM documents
"""

# The bytes of a landed file: Windows line ends, and some files that are not UTF-8.
LANDED = r"""
SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS crlf_text, doc_id%10=3 AS broken FROM documents
"""


def spark_sql(template: str) -> str:
    return template.format(S="STRING")


def duck_sql(template: str) -> str:
    return template.format(S="VARCHAR")


COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
    "documents": ["doc_id", "text"],
    "pages": ["page_id", "html"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{name}.parquet", COLUMNS[name])


def derive(template: str, **tables: DataFrame) -> DataFrame:
    """Run a template over the given tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(_with_names(spark_sql(template), tables), **tables)


def _with_names(sql: str, tables: dict[str, DataFrame]) -> str:
    """Name each table as a common table expression over its parameter."""
    ctes = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in tables)
    return f"WITH {ctes} {sql.replace('{', '{{').replace('}', '}}')}"


def business_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(BUSINESS_DOCUMENTS, orders=table(spark, sf_dir, "orders"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(REVIEWS, events=table(spark, sf_dir, "events"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(AGENT_EVENTS, t=derive(AGENT_EVENTS_BASE, orders=table(spark, sf_dir, "orders")))
