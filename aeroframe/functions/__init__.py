"""Scalar physics as Column -> Column expressions; nothing here shuffles or leaves the JVM."""
