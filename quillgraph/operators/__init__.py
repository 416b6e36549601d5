"""quillgraph.operators"""
