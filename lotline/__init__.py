"""lotline: dealership inventory analytics as Spark DataFrame operators.

Captured dealer pages (semi-structured JSON) are extracted and normalised into
a typed listing schema, merged into a VIN-keyed vehicle table, and queried with
filters, searches, sorts, counts and run-tracking reports.  Every operator is a
DataFrame -> DataFrame (or Column builder) function over built-in expressions.
"""

__version__ = "0.1.0"
