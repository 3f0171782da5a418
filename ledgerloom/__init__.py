"""Reconciliation of order ledger, settlement legs and bank lines on Spark."""
