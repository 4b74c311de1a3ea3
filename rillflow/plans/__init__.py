"""Binding of syntax trees to typed Spark columns and frames."""
