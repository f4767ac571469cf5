"""File-corpus, web-response and call-record analytics as Spark DataFrame operators."""
