"""Graphloom: analytics over large collections of small labelled graphs, on Spark."""
