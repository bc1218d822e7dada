"""Graph operators over entity and edge tables."""
