"""Readers that turn raw bytes and the sample tables into typed rows."""
