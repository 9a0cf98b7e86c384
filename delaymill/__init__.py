"""Delay analytics over stop events, written for Spark."""
