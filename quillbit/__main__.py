from quillbit.cli import main

main()
