"""Training-data operators: document, vector, page, conversation and tokenizer jobs.

Nothing outside this folder imports it; deleting it leaves the library whole.
"""
