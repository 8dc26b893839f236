"""Readers and writers. All reading goes through Spark's file readers, so paths may be in any store that Spark reaches."""
