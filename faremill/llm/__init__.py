"""Training-data operators over document, label and embedding tables."""
