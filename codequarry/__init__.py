"""Code-quality analytics on Spark: code and documents as fact tables, rules and measures as queries."""
